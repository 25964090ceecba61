from __future__ import annotations

import math
import random

from seriesloom.llm.quality import LABELLERS, keep_good, posteriors, score_documents, votes


def prose(r: random.Random, n: int) -> str:
    return " ".join(" ".join(r.choice(["river", "the", "of", "stone", "walks", "and", "green", "a", "to", "light", f"w{i % 37}ord"]) for i in range(9)).capitalize() + "." for _ in range(n))


def junk(r: random.Random) -> str:
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(["Same"] * r.randrange(60, 200))
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in prose(r, 12).split())
    return " ".join(w + r.choice(["", "", " "]) + r.choice(["###", "%%%", "***", "$$$"]) for w in prose(r, 12).split())


def test_held_out_accuracy_without_labels(spark):
    r = random.Random(3)
    rows = [(i, junk(r) if i % 6 == 0 else prose(r, r.randrange(8, 40)), i % 6 != 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, truth boolean")
    got = score_documents(df).collect()
    assert sum(x["__keep"] == x.truth for x in got) / len(got) > 0.98


def test_defined_cases(spark):
    assert keep_good(spark.createDataFrame([], "doc_id long, text string, score string")).collect() == []
    rows = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "word", "c")]
    got = keep_good(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "text", "score"}


def test_em_trusts_labellers_that_agree():
    good, bad = sum(3**i for i in range(len(LABELLERS))), sum(2 * 3**i for i in range(len(LABELLERS)))
    q = posteriors({good: 900, bad: 100, 0: 10})
    assert q[good] > 0.95 > 0.05 > q[bad]
    assert posteriors({}) == {}
    assert len(votes("x")) == len(LABELLERS)


def test_short_junk_goes_and_short_prose_stays(spark):
    r = random.Random(4)
    rows = [(i, junk(r) if i % 6 == 0 else prose(r, r.randrange(1, 40)), "") for i in range(1500)]
    bad = ["$$$ ### %%% @@@", "Spam " * 12, "BUY NOW!!! " * 3, "CLICK HERE!! NOW!!"]
    good = [" ".join(prose(r, 1).split()[:6]) + "." for _ in range(20)] + [prose(r, 1) for _ in range(20)]
    rows += [(5000 + i, t, "bad") for i, t in enumerate(bad)] + [(6000 + i, t, "good") for i, t in enumerate(good)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string, truth string")).where("truth <> ''").collect()
    assert [x.text for x in got if x.truth == "bad" and x["__keep"]] == []
    assert [x.text for x in got if x.truth == "good" and not x["__keep"]] == []


def test_em_equals_a_plain_loop():
    r = random.Random(6)
    counts = {sum(r.choice([0, 1, 1, 2]) * 3**i for i in range(len(LABELLERS))): r.randrange(1, 50) for _ in range(60)}
    votes_of = {p: [p // 3**i % 3 for i in range(len(LABELLERS))] for p in counts}
    q = {p: (1 + v.count(1)) / (2 + v.count(1) + 3 * v.count(2)) for p, v in votes_of.items()}
    for _ in range(50):
        weight = {c: {p: counts[p] * (q[p] if c else 1 - q[p]) for p in counts} for c in (0, 1)}
        whole = sum(counts.values())
        like = {}
        for c in (0, 1):
            total = sum(weight[c].values())
            share = [[(sum(w for p, w in weight[c].items() if votes_of[p][i] == o) + 1) / (total + 3) for o in range(3)] for i in range(len(LABELLERS))]
            like[c] = {p: math.log((total + 1) / (whole + 2)) + sum(math.log(share[i][o]) for i, o in enumerate(v)) for p, v in votes_of.items()}
        q = {p: 1 / (1 + math.exp(like[0][p] - like[1][p])) for p in counts}
    objections = lambda c: sum(weight[c][p] * votes_of[p].count(2) for p in counts) / sum(weight[c].values())
    weight = {c: {p: counts[p] * (q[p] if c else 1 - q[p]) for p in counts} for c in (0, 1)}
    turned = objections(1) > objections(0)
    got = posteriors(counts)
    assert all(abs(got[p] - (1 - q[p] if turned else q[p])) < 1e-6 for p in counts)
