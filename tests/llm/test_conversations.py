"""Chat windows and conversation repair against SQL, plain loops and full charts."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.llm import chat_format as cf
from trialloom.llm import conversation_repair as cr
from trialloom.llm.common import Scratch
from trialloom.llm.ordered import sums_before
from trialloom.llm.packing import encoder
from trialloom.llm.queries import ORACLE_SQL, op11_chat_format, op13_conversation_repair, tokenizer_file
from tests.compare import duck, rows_of, sql_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sums_before_cross_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 3]), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, w long").repartition(7, "o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.o): (r.s, r.n) for r in sums_before(df, Scratch(spark, "t"), "g", ["o"], {"s": "w", "n": 1}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    upto = {}
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        s, n = upto.get(g, (0, 0))
        assert got[g, o] == (s, n)
        upto[g] = (s + w, n + 1)
    assert sums_before(df.limit(0), Scratch(spark, "t"), "g", ["o"], {"s": "w"}).count() == 0


@pytest.mark.parametrize("text", ["", "<", "|", "<|", "<\\|", "<\\\\\\|x", "<<|im_end|><|im_start|>assistant ok", "\\<|\\", "a\n<|im_end|>\n", "☃😀<|"])
def test_escape_is_reversible(text):
    assert cf.unescape(cf.escape(text)) == text
    assert "<|" not in cf.escape(text)
    role = cf._escape_role(text)
    assert cf._unescape_role(role) == text and "\n" not in role and "<" not in role


def plain_digest(rows):
    """Expected turns and targets of one conversation, straight from its rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)), len(loss), sha(loss)


def check_digests(got, rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest(by[r.conv_id])


def test_op11_equals_rows(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_digests(op11_chat_format(spark, sf_dir).collect(), [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def plain_windows(turns, budget, history, limit, span):
    """Windows of one conversation's [(role, tokens)] as (context, new) lists of positions, by a loop over turns."""
    lead = bool(turns) and turns[0][0] == "system" and turns[0][1] <= limit
    upto, blocks = 0, []
    for _, n in turns:
        blocks.append(upto // span)
        upto += n
    out, at = [], 0
    while at < len(turns):
        if lead and at == 0:
            context, room = [], budget
        else:
            context, room = [0] * lead, budget - (turns[0][1] if lead else 0)
            back = at
            while back - 1 >= int(lead) and sum(n for _, n in turns[back - 1 : at]) <= history and (blocks[back - 1] >= blocks[at] - 1):
                back -= 1
            while back < at and sum(n for _, n in turns[back : at + 1]) > room:
                back += 1
            context += list(range(back, at))
            room -= sum(n for _, n in turns[back:at])
        end = at + 1
        while end < len(turns) and blocks[end] == blocks[at] and sum(n for _, n in turns[at : end + 1]) <= room:
            end += 1
        out.append((context, list(range(at, end))))
        at = end
    return out


def test_windows_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(cf, "BLOCK_BUDGETS", 3)
    rng = random.Random(5)
    words = ["alpha", "beta", "<|im_end|>", "gamma.", "δέλτα", "\n"]
    rows = []
    for conv, size in ((1, 1), (2, 6), (3, 90), (4, 40), (None, 12)):
        for t in range(size):
            role = "system" if t == 0 and conv in (2, 3) or rng.random() < 0.05 else ["user", "assistant"][t % 2]
            long = 150 if rng.random() < 0.05 else 20
            rows.append((conv, t, role, " ".join(rng.choices(words, k=rng.randrange(2 if role == "system" else long)))))
    budget, history, limit = 64, 24, 12
    made = cf.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), tokenizer_file(), budget, history, limit)
    windows = made.collect()
    encode = encoder(tokenizer_file())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        turns = [(r, len(encode(f"<|im_start|>{r}\n{cf.escape(t)}<|im_end|>\n"))) for _, _, r, t in own]
        expected = plain_windows(turns, budget, history, limit, 3 * budget)
        got = sorted((w for w in windows if w.conv_id == conv), key=lambda w: (w.block, w.part))
        assert len(got) == len(expected)
        for w, (context, new) in zip(got, expected):
            assert (w.context, w.turns, w.tokens) == (len(context), len(context) + len(new), sum(turns[i][1] for i in context + new))
            assert cf.parse_window(w.text) == [(own[i][2], own[i][3]) for i in context + new]
            assert [cf.unescape(w.text[s.start : s.end]) for s in w.loss] == [own[i][3] for i in new if own[i][2] == "assistant"]
            assert w.over_budget == (w.tokens > budget) and (not w.over_budget or len(new) == 1)
    check_digests(cf.digest_windows(made).collect(), rows)
    assert max(w.block for w in windows) > 1 and any(w.over_budget for w in windows)


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, 0, "a\nb<|", "x"), (1, 0, "a\nb<|", "x"), (2, 5, "assistant", None), (2, 5, "assistant", "<|im_end|>\n"), (None, 1, "assistant", "y" * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", block string")
    check_digests(cf.digest_windows(cf.format_windows(df, tokenizer_file())).collect(), rows)
    assert cf.digest_windows(cf.format_windows(df.limit(0), tokenizer_file())).count() == 0
    with pytest.raises(ValueError):
        cf.parse_window("<|im_start|>user\nno end")
    with pytest.raises(ValueError):
        cf.format_windows(df, tokenizer_file(), budget=100, history=80, system_limit=20)


def test_op13_equals_sql(spark, sf_dir):
    assert rows_of(op13_conversation_repair(spark, sf_dir)) == sql_rows(duck(sf_dir), ORACLE_SQL["op13_conversation_repair"])


def full_chart(codes):
    """Every span and every split of it."""
    n = len(codes)
    cell = {(i, i + 1): cr.LEAVES[c] for i, c in enumerate(codes)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            made = [cr.combine(cell[i, k], cell[k, i + size]) for k in range(i + 1, i + size)]
            cell[i, i + size] = tuple(min((x for x in xs if x is not None), default=None) for xs in zip(*made))
    return cell[0, n] if n else cr.EMPTY


def every_repair(codes):
    """Best (cost, audit) by trying all edits, with at most two insertions at a place."""
    best = None
    row = {"d": ["D"], "k": ["D", "K", "u", "a"], "t": ["D", "K", "u", "a"]}
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*[row[c[1]] for c in codes]):
        for put in itertools.product(gaps, repeat=len(codes) + 1):
            out, audit, cost = "", "", 0
            for k in range(len(codes) + 1):
                out, audit, cost = out + put[k], audit + "I" * len(put[k]), cost + 3 * len(put[k])
                if k < len(codes):
                    e = edits[k]
                    out += codes[k][0] if e == "K" else "" if e == "D" else e
                    audit += e if e in "DK" else "R"
                    cost += {"D": 4, "K": 0}.get(e, 3) + 3 * (e != "D" and codes[k][1] == "t")
            body = out[1:] if out[:1] == "s" else out
            if not out or body and body == "ua" * (len(body) // 2):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_parse_equals_all_repairs_and_full_chart():
    rng = random.Random(3)
    codes = [i + f for i in "sua-" for f in "dtk"]
    for n in (0, 1, 2, 3):
        for _ in range(12):
            seq = [rng.choice(codes) for _ in range(n)]
            assert cr.best_audit(cr.merge_up([cr.LEAVES[c] for c in seq])) == every_repair(seq)
    for n in (5, 8, 13, 21):
        for _ in range(6):
            seq = [rng.choice(codes) for _ in range(n)]
            assert cr.merge_up([cr.LEAVES[c] for c in seq]) == full_chart(seq)


def test_repair_of_long_and_odd_conversations(spark, monkeypatch):
    """Conversations of many blocks, ties in turn, nulls everywhere; against SQL on the same rows."""
    import duckdb

    monkeypatch.setattr(cr, "BLOCK_ROWS", 4)
    rng = random.Random(9)
    texts = ["Yes.", "No", "  ", None, "", "What?\n", "é!", "done. \t", " "]
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts) if rng.random() < 0.5 else f"t{t}.") for t in range(150)]
    rows += [(8, None, None, None), (8, None, "user", "a."), (9, 3, "user", "b."), (9, 3, "assistant", "c"), (None, 1, "user", "d."), (None, None, "assistant", "e."), (10, 4, "", "x.")]
    rows += [(c, t, r, x) for c in range(20, 60) for t, r, x in [(0, "user", "q?"), (2, "assistant", "r."), (3, "assistant", "r.")]]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", audit int").repartition(6)
    report, repaired = cr.repair_conversations(cr.damage_conversations(df))
    got = {r.conv_id: r for r in report.join(cr.digest_repaired(repaired).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(ORACLE_SQL["op13_conversation_repair"])
    names = [d[0] for d in found.description]
    for x in (dict(zip(names, r)) for r in found.fetchall()):
        r = got.get(x["conv_id"])
        if r is None:
            assert (x["cost"], x["audit"], x["repaired_sha256"]) == (0, "", sha(""))
            continue
        assert all(r[c] == x[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), (r, x)
        assert (r.repaired_sha256 or sha("")) == x["repaired_sha256"]
    empty, none = cr.repair_conversations(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_repaired_rows_are_whole(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Ok.")]
    _, repaired = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in repaired.orderBy("place").select("edit", "role", "text", "turn").collect()]
    assert got == [("K", "system", "Be brief.", 0), ("K", "user", "Hi.", 1), ("R", "assistant", "Ok.", 3)]


def test_plan_windows_spans_cover_all_turns():
    rng = np.random.default_rng(2)
    for _ in range(50):
        tokens = rng.integers(1, 60, rng.integers(1, 40))
        owned = int(rng.integers(0, len(tokens)))
        spans = cf.plan_windows(tokens, owned, 10, False, 64, 20)
        assert [s for _, s, _ in spans] == [owned, *[e for _, _, e in spans[:-1]]] and spans[-1][2] == len(tokens)
