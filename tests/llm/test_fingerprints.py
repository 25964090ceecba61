from __future__ import annotations

import hashlib
import re
import unicodedata

from seriesloom.llm.fingerprints import op3_fingerprints


def canon(t: str) -> str:
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


def test_equals_brute_force(spark, tmp_path):
    texts = ["a \u00a0\t b", "A b", "a\x1cb", "Héllo  World", "héllo world ", "ＦＵＬＬ width", "full width", "", None, "a" * 5000, "ß straße", "ss STRASSE", "x", "Same", "same", "same\n"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    plain = [t or "" for t in texts]
    groups: dict[str, list[int]] = {}
    for (d, _), t in zip(rows, plain, strict=True):
        groups.setdefault(canon(t), []).append(d)
    for i, (d, _) in enumerate(rows):
        t, after = plain[i], plain[(i + 1) % len(plain)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canon(edited) == canon(t)) and r.near_next == float(canon(after) == canon(t))
        assert (r.group_id, r.group_size) == (min(groups[canon(t)]), len(groups[canon(t)]))
    assert len({r.fingerprint for r in got.values()}) == len(groups)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_fingerprints(spark, str(tmp_path)).collect() == []


def test_repeated_null_ids_and_clashing_columns(spark, tmp_path):
    rows = [(None, "Null"), (None, None), (1, "Same text"), (1, "same TEXT"), (1, "other"), (1, "other"), (7, "same text"), (7, "same text")]
    schema = "doc_id long, text string, fp string, canon string, size string, k string"
    spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.group_size, r.group_id or 0) for r in got) == sorted([(0, 4, 1, 0), (0, 0, 1, 0), *[(1, 9, 4, 1)] * 2, *[(1, 5, 2, 1)] * 2, *[(7, 9, 4, 1)] * 2])
