import math
import re
import zlib
from collections import Counter

import numpy as np

from weftspark.llm import hpylm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def check_base(df, **how):
    got = hpylm.score_texts(df, **how).collect()
    docs = [(r["doc_id"], tokens(r["text"])) for r in df.collect()]
    train = Counter(t for d, ts in docs if not held(d) for t in ts)
    n, v = sum(train.values()), len(train)
    want = sorted(((d, held(d), len(ts), sum(train[t] > 0 for t in ts), n, round(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4)) for d, ts in docs), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)
    return got


def test_base_columns_on_awkward_documents(awkward):
    check_base(awkward)
    check_base(awkward, block_words=200, hot=50)


def test_nothing(nothing):
    assert hpylm.score_texts(nothing).collect() == []


def test_only_held_out_rows(spark):
    ids = [k for k in range(300) if held(k)][:5]
    df = spark.createDataFrame([(k, "some words here") for k in ids], "doc_id bigint, text string")
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in hpylm.score_texts(df).collect()} == {(0, 0, 0.0)}


def test_contexts_and_back_off(spark):
    """What follows a context often is likelier there; the unknown class has its share of the unigram."""
    train = [k for k in range(60) if not held(k)][:30]
    probe = [k for k in range(1000, 4000) if held(k)]
    rows = [(k, "a b a b c d c d a b x") for k in train] + [(probe[0], "c d x"), (probe[1], "c b x"), (probe[2], "new"), (probe[3], "new new"), (probe[4], "new new new")]
    score = {r["doc_id"]: r["score"] for r in hpylm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert score[probe[0]] > score[probe[1]] + 0.5
    steps = [score[probe[3]] - score[probe[2]], score[probe[4]] - score[probe[3]]]
    assert steps[0] < 0 and abs(steps[0] - steps[1]) < 1e-9


def test_restaurants_normalise():
    """Mean tables keep every restaurant's predictive mass at one."""
    rng = np.random.default_rng(1)
    c = rng.integers(2, 400, 300)
    group = rng.integers(0, 10, 300)
    fixed = rng.integers(0, 30, 10).astype(float)
    parent = np.full(300, 1e-3)
    d, theta = 0.7, 2.0
    mean, tables = hpylm.seat(c, group, fixed, np.ones(10), parent, d, theta, sweeps=12, burn=4, seed=2)
    assert (mean >= 1).all() and (mean <= c).all()
    for g in range(10):
        customers = c[group == g].sum() + fixed[g]
        seats = (c[group == g] - d * mean[group == g]).sum() + (1 - d) * fixed[g]
        assert abs(seats + d * tables[g] - customers) < 1e-6


def test_gibbs_matches_exact_distribution():
    """One dish: the mean number of tables agrees with the sum over its exact distribution."""
    d, theta, parent = 0.5, 1.0, 0.3
    for c in (2, 5, 12):
        size = hpylm.closing_table(d)
        # P(t) ~ S(c, t) parent^t prod_{i<t} (theta + d i), with S from the closing ratios' recursion
        S = np.zeros((c + 1, c + 1))
        S[0, 0] = 1
        for n in range(1, c + 1):
            for t in range(1, n + 1):
                S[n, t] = S[n - 1, t - 1] + (n - 1 - t * d) * S[n - 1, t]
        assert abs(size[c, 1] - (S[c - 1, 0] / S[c, 1])) < 1e-9
        weight = [0.0] + [S[c, t] * parent**t * math.prod(theta + d * i for i in range(t)) for t in range(1, c + 1)]
        exact = sum(t * w for t, w in enumerate(weight)) / sum(weight)
        n = 2000
        mean, _ = hpylm.seat(np.full(n, c), np.arange(n), np.zeros(n), np.ones(n), np.full(n, parent), d, theta, sweeps=400, burn=200, seed=c)
        assert abs(mean.mean() - exact) < 0.05 * exact


def test_production_sweeps_reach_the_exact_mean():
    d, theta, parent = 0.7, 2.0, 0.3
    t = np.arange(121)
    row = np.where(t == 0, 0.0, -np.inf)  # log S(c, t) up to 120 tables
    for c in range(1, 3001):
        with np.errstate(divide="ignore"):
            row = np.logaddexp(np.r_[-np.inf, row[:-1]], np.log(np.maximum(c - 1 - t * d, 0)) + row)
        row[0] = -np.inf
        if c not in (10, 200, 3000):
            continue
        weight = row + t * math.log(parent) + np.r_[0, np.cumsum(np.log(theta + d * t[:-1]))]
        weight = np.exp(weight - weight.max())
        exact = (t * weight).sum() / weight.sum()
        n = 2000
        mean, _ = hpylm.seat(np.full(n, c), np.arange(n), np.zeros(n), np.ones(n), np.full(n, parent), d, theta, sweeps=12, burn=4, seed=c)
        print(c, mean.mean(), exact)
        assert abs(mean.mean() - exact) < 0.07 * exact


def test_scores_do_not_follow_the_layout(spark, prose):
    """Partitions, input splits and the size of blocks change nothing; nor do copies of the bucket's size beyond one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions, split, block in ((2, 1, 10**6), (7, 5, 10**6), (3, 2, 500)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = hpylm.score_texts(prose.repartition(split), block_words=block, bucket_words=1000).collect()
            found.append({r["doc_id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in found[1:]:
        assert other.keys() == found[0].keys() and all(abs(other[k] - v) < 1e-6 for k, v in found[0].items())


def test_counts_beyond_any_code():
    """The parent probability is told within a tenth of a percent at every size."""
    for n in (1, 3, 4 * 10**9, 4 * 10**10, 10**12, 10**18):
        code = np.round(1000 * np.log2(n)).astype(np.uint16)
        assert abs(np.exp2(code / 1000.0) / n - 1) < 1e-3


def test_rows_only_for_buckets_that_get_something():
    assert hpylm._spans(np.array([2, 2, 5, 9, 9, 9])) == {2: (0, 2), 5: (2, 3), 9: (3, 6)} and hpylm._spans(np.empty(0, np.int64)) == {}
    order, spans = hpylm._dealt([b"a", b"b", b"c"], 10**9)
    assert sorted(order.tolist()) == [0, 1, 2] and sum(b - a for a, b in spans.values()) == 3 and len(spans) == 3


def test_perplexity(prose):
    scores = hpylm.score_texts(prose)
    got = {r["held_out"]: r for r in hpylm.perplexity(scores).collect()}
    rows = scores.collect()
    for side in (False, True):
        mine = [r for r in rows if r["held_out"] == side]
        assert got[side]["n_texts"] == len(mine) and got[side]["n_tokens"] == sum(r["n_tokens"] for r in mine)
        want = 10 ** (-sum(r["score"] for r in mine) / sum(r["n_tokens"] for r in mine))
        assert abs(got[side]["perplexity"] / want - 1) < 1e-9
    base = {r["held_out"]: r["perplexity"] for r in hpylm.perplexity(scores, score_col="base_score").collect()}
    assert got[True]["perplexity"] < base[True]
    assert hpylm.perplexity(scores.limit(0)).collect() == []


def test_model_beats_base(prose):
    got = [r for r in hpylm.score_texts(prose).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


class PlainModel:
    """The same hierarchy customer by customer: each leaves and sits down again, its table being a customer above."""

    def __init__(self, d1, d0, theta, top_theta, words, seed):
        self.d, self.theta, self.base = {1: d1, 0: d0}, {1: theta, 0: top_theta}, 1 / (words + 1)
        self.rooms, self.rng = {}, np.random.default_rng(seed)

    def p(self, u, w):
        level = 0 if u is None else 1
        above = self.base if u is None else self.p(None, w)
        room = self.rooms.get(u, {})
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(w, [])
        return (sum(own) - self.d[level] * len(own) + (self.theta[level] + self.d[level] * t) * above) / (self.theta[level] + c)

    def sit(self, u, w):
        level = 0 if u is None else 1
        room = self.rooms.setdefault(u, {})
        own = room.setdefault(w, [])
        above = self.base if u is None else self.p(None, w)
        weights = np.array([n - self.d[level] for n in own] + [(self.theta[level] + self.d[level] * sum(map(len, room.values()))) * above])
        k = self.rng.choice(len(weights), p=weights / weights.sum())
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if u is not None:
                self.sit(None, w)

    def leave(self, u, w):
        own = self.rooms[u][w]
        k = self.rng.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        if not own[k]:
            del own[k]
            if u is not None:
                self.leave(None, w)


def test_scores_agree_with_customer_by_customer_sampling(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(25)]
    follow = {w: rng.choice(words, 4) for w in words}
    rows = []
    for k in range(120):
        w, text = rng.choice(words), []
        for _ in range(rng.integers(3, 15)):
            text.append(str(w))
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.choice(words)
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: r["score"] for r in hpylm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    pairs = [(a, b) for k, t in rows if not held(k) for a, b in zip(["", *tokens(t)], tokens(t))]
    single, double = Counter(b for _, b in pairs), Counter(pairs)
    rate = lambda c: hpylm.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    model = PlainModel(rate(double), rate(single), 2.0, 100.0, len(single), 5)
    for u, w in pairs:
        model.sit(u, w)
    total, sweeps = Counter(), 24
    probe = [(k, list(zip(["", *tokens(t)], tokens(t)))) for k, t in rows[:60]]
    mean = {}
    for sweep in range(sweeps):
        for u, w in pairs:
            model.leave(u, w)
            model.sit(u, w)
        if sweep >= 8:
            for _, ts in probe:
                for u, w in set(ts):
                    mean[u, w] = mean.get((u, w), 0) + 0
            for u, w in mean:
                total[u, w] += model.p(u, w)
    want = {k: sum(math.log10(total[x] / (sweeps - 8)) for x in ts) for k, ts in probe}
    off = [abs(got[k] / want[k] - 1) for k in want]
    print(max(off), np.mean(off))
    assert max(off) < 0.06 and np.mean(off) < 0.02
