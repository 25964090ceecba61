"""Chat formatting against plain Python and its SQL."""

from __future__ import annotations

import hashlib
import random

from seriesloom.llm.chat import OP10_SQL, format_chats, op10_chat_format, read_chats
from tests.oracle import difference

BITS = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "\\", "<", "|", "<\\|", "<\\/", "\n", "a", "é😀", "assistant", " "]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(BITS) for _ in range(r.randrange(n)))
    out = []
    for conv in [*range(40), None]:
        for _ in range(r.randrange(1, 7)):
            out.append((conv, r.choice([None, 0, 1, 2]), r.choice([None, "user", "assistant", text(4)]), r.choice([None, "", text(8)]), "x"))
        out += [r.choice(out)[:4] + ("y",)] * r.randrange(3)  # repeated rows, also of other conversations
    return [*out, (50, 0, "user", "hi", ""), (50, 0, "user", "hi", ""), (50, 1, "assistant", "yo", ""), (51, 0, "assistant", "z" * 200_000 + "<|im_sep|>", "")]


def order(t: tuple) -> tuple:
    return (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")


def test_round_trip_of_ties_nulls_and_control_strings(spark):
    given = rows(1)
    got = {r.conv_id: r for r in read_chats(format_chats(spark.createDataFrame(given, SCHEMA))).collect()}
    chats: dict = {}
    for t in given:
        chats.setdefault(t[0], []).append(t)
    assert got.keys() == chats.keys()
    for conv, turns in chats.items():
        told = [(t[2] or "", t[3] or "") for t in sorted(turns, key=order)]
        assert [(t.role, t.text) for t in got[conv].turns] == told, conv
        assert got[conv].loss_texts == [x for role, x in told if role == "assistant"]


def test_equals_its_sql(spark, tmp_path):
    import duckdb

    given = rows(2)
    spark.createDataFrame(given, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = op10_chat_format(spark, str(tmp_path))
    assert difference(got, con, OP10_SQL) == ""
    planted = next(r for r in got.collect() if r.conv_id == -1)
    assert planted.loss_sha256 == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()


def test_empty_table(spark):
    assert read_chats(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
