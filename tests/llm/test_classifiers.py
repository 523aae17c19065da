import random

import numpy as np
import pytest

from weftspark.llm import langid, puquality, toxicity
from weftspark.llm.sampling import below, bounded, chosen, fold

from .conftest import rows_of


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    got = spark.createDataFrame([(k,) for k in (0, 7, 123456789)], "doc_id bigint").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def test_bounded_sample_is_bounded_and_repeats(spark):
    df = spark.range(10_000).selectExpr("id", "id % 2 AS y")
    one = rows_of(bounded(df, "y", "id", 300), "id")
    assert 450 < len(one) < 750 and one == rows_of(bounded(df.repartition(7), "y", "id", 300), "id")
    assert bounded(df.limit(0), "y", "id", 300).count() == 0


def test_sample_of_any_share(spark):
    """1500 of 10^10 rows: the limit must neither be out of reach nor let too many through."""
    assert below(10, 10) is None and below(10, 3) is None
    for most, n in ((1500, 10**10), (8000, 10**15), (1, 3), (4000, 4001)):
        assert abs((below(most, n) + (1 << 63)) / 2**64 - most / n) <= 2**-53
    ids = spark.range(400_000)
    assert 150 < ids.filter(chosen("id", below(200, 400_000))).count() < 250
    assert 400_000 * 1500 / 10**10 < 1 and ids.filter(chosen("id", below(1500, 10**10))).count() <= 2


# ---- language


def test_language(prose):
    model = langid.fit(prose)
    got = {r["doc_id"]: r for r in langid.identify(prose, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in prose.collect()}
    assert np.mean([got[k]["lang_pred"] == v for k, v in truth.items()]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_tables_equal_plain_convolution(prose):
    model = langid.ByteCNN.fresh(["x", "y"], 3)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, 255, 256, 700)]
    got = model.predict(texts, most=512)
    p = model.params
    for t, probs in zip(texts, got):
        rows, counts = langid._laid_out([t])
        outs, weights = [], []
        for w in range(counts[0]):
            s = rows[w]
            hidden = np.concatenate([sum((p["embed"] @ p[f"filter{k}"][j])[s[j : j + 256]] for j in range(k)).max(axis=0) for k in langid.WIDTHS])
            outs.append(langid._softmax((np.maximum(hidden, 0) @ p["out"] + p["bias"])[None])[0])
            weights.append(((s[:256] < 26) | (s[:256] > 28)).sum() + 1e-3)
        want = np.average(outs, axis=0, weights=weights)
        assert np.allclose(probs, want, atol=1e-4)


def test_language_gradients():
    model = langid.ByteCNN.fresh(["x", "y"], 1)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    rng = np.random.default_rng(0)
    sym = rng.integers(0, langid.SYMBOLS, (3, 259)).astype(np.uint8)
    truth = np.array([0, 1, 1])
    grads = model._gradients(sym, truth)

    def loss():
        hidden = np.concatenate([sum((model.params["embed"] @ model.params[f"filter{w}"][j])[sym[:, j : j + 256]] for j in range(w)).max(axis=1) for w in langid.WIDTHS], axis=1)
        return -np.log(langid._softmax(np.maximum(hidden, 0) @ model.params["out"] + model.params["bias"])[np.arange(3), truth]).mean()

    for name in ("out", "bias", "filter3", "embed"):
        at = tuple(0 for _ in model.params[name].shape)
        model.params[name][at] += 1e-6
        up = loss()
        model.params[name][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - grads[name][at]) < 1e-4
        model.params[name][at] += 1e-6


def test_scripts_beyond_latin(spark):
    """Lead bytes of other scripts are told apart; held-out rows, whose labels were not read."""
    rng = random.Random(3)
    letters = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρσ", "ar": "ابتثجحخدذرزسشصضطظع", "ja": "あいうえおかきくけこさしすせそ", "ko": "가나다라마바사아자차카타파하"}
    rows = []
    for k in range(1000):
        lang = sorted(letters)[k % 5]
        rows.append((k, " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(2, 30))), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).filter(fold("doc_id", 5) == 0).collect()}
    assert len(got) > 150 and np.mean([got[k] == rows[k][2] for k in got]) > 0.97


def test_language_of_the_held_out_fold(prose):
    got = langid.identify(prose, langid.fit(prose)).filter(fold("doc_id", 5) == 0).collect()
    assert len(got) > 30 and np.mean([r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") for r in got]) > 0.97


def test_language_of_awkward_texts(prose, awkward, nothing):
    model = langid.fit(prose)
    got = langid.identify(awkward, model)
    assert got.count() == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for r in got.filter("doc_id IS NOT NULL").collect():
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    assert {r["lang_pred"] for r in langid.identify(awkward, None).collect()} == {"und"}
    assert langid.fit(nothing) is None and langid.identify(nothing, None).collect() == []
    kept = langid.keep_identified(awkward, model, min_score=0.0)
    assert kept.columns == awkward.columns and kept.filter("text IS NULL").count() == 0


# ---- quality


@pytest.fixture(scope="module")
def quality(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(600):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "some", "more"]) + str(rng.randint(0, 400)) for _ in range(rng.randint(20, 150))]
        good = k % 4 != 0
        docs.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:8] * 6)))
        if k % 3 != 1:
            labels.append((k, int(good), None))
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([*labels, (None, 1, None), (5, None, None)], "doc_id bigint, quality int, text string")


def test_quality(quality):
    docs, labels = quality
    model = puquality.fit(docs, labels)
    assert 0.65 < model.prior < 0.85
    got = {r["doc_id"]: r["predicted"] for r in puquality.judge(docs, model).collect()}
    assert np.mean([got[k] == int(k % 4 != 0) for k in got]) > 0.97


def test_quality_of_the_held_out_fold(quality):
    """Accuracy on rows whose labels were never read; labels of 0 change nothing."""
    docs, labels = quality
    model = puquality.fit(docs, labels)
    got = puquality.judge(docs, model).filter(fold("doc_id", 5) == 0).collect()
    assert len(got) > 80 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got]) > 0.97
    same = puquality.fit(docs, labels.filter("quality = 1"))
    assert same.prior == model.prior and np.array_equal(same.w1, model.w1)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(3)
    draw = lambda good: rng.normal(1.5 if good else -1.5, 1, puquality.FEATURES) * np.r_[np.ones(3), np.zeros(puquality.FEATURES - 3)]
    positive = np.array([draw(True) for _ in range(1500)])
    unlabelled = np.array([draw(rng.random() < share) for _ in range(3000)])
    assert abs(puquality.estimate_prior(positive, unlabelled) - share) < 0.06


@pytest.mark.parametrize("prior", [None, 0.3, 0.9])
def test_risk_and_gradients(prior):
    """The risk against its definition, row by row; the gradients against differences of it."""
    rng = np.random.default_rng(0)
    p = [rng.normal(0, 1, (5, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3), rng.normal(0, 1, 1)]
    xp, xu = rng.normal(0.5, 1, (7, 5)), rng.normal(0, 1, (11, 5))

    def risks():
        out = lambda x: sum(np.tanh(sum(x[i] * p[0][i, j] for i in range(5)) + p[1][j]) * p[2][j] for j in range(3)) + p[3][0]
        plus, minus = (lambda x: np.log(1 + np.exp(-out(x)))), (lambda x: np.log(1 + np.exp(out(x))))
        mean = lambda f, rows: sum(map(f, rows)) / len(rows)
        share, less = (1, 0) if prior is None else (prior, prior)
        return share * mean(plus, xp), mean(minus, xu) - less * mean(minus, xp)

    turned = set()
    for _ in range(2):
        positive, negative, grads = puquality._loss_gradients(p, xp, xu, prior)
        assert np.allclose((positive, negative), risks())
        turned.add(negative < 0)
        goal = (lambda: sum(risks())) if negative >= 0 else (lambda: -risks()[1])
        for w, g in zip(p, grads):
            for at in np.ndindex(w.shape):
                w[at] += 1e-5
                up = goal()
                w[at] -= 2e-5
                assert abs((up - goal()) / 2e-5 - g[at]) < 1e-5
                w[at] += 1e-5
        # positives far on their side, unlabelled on the other: the negative risk falls below 0
        some = rng.normal(0, 3, (200, 5))
        by = np.argsort(np.tanh(some @ p[0] + p[1]) @ p[2])
        xp, xu = some[by[-7:]], some[by[:11]]
    assert prior is None or True in turned


def test_quality_of_awkward_texts(quality, awkward, nothing, spark):
    docs, labels = quality
    model = puquality.fit(docs, labels)
    got = puquality.judge(awkward, model)
    assert got.count() == awkward.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert puquality.fit(awkward, labels.limit(0)) is None and puquality.fit(nothing, labels) is None
    assert {r["score"] for r in puquality.judge(awkward, None).collect()} == {0.5}
    assert puquality.judge(nothing, model).collect() == []
    assert puquality.keep_good(awkward, None).count() == awkward.count()
    assert len(puquality.statistics(None)) == len(puquality.statistics("a b")) == puquality.FEATURES


# ---- toxicity


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(600):
        words = [rng.choice(["the", "of", "house", "river", "tree", "stone", "and", "with"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(10, 80))]
        bad = k % 3 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "idiot", "stupid", "loser"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad), "x"))
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([*labels, (None, 1, None), (2, None, None)], "doc_id bigint, toxic int, text string")


def test_toxicity(insults, spark):
    docs, labels = insults
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.judge(docs, model).collect()}
    assert np.mean([got[k] == int(k % 3 == 0) for k in got]) > 0.97
    hidden = ["the house m0r0n and tree", "you 1d10t of the river", "s t u p i d and the stone", "the looooser of houses", "st.up.id with the trees", "l0s3r"]
    clean = ["the house of the river and 10 trees", "call 555-1234 with the stones", "aaa bbb ccc", "it's a tree-house"]
    probe = spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id bigint, text string")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.judge(probe, model).collect()}
    assert [scores[k] for k in range(len(hidden))] == [1] * len(hidden)
    assert [scores[k + len(hidden)] for k in range(len(clean))] == [0] * len(clean)


def test_viterbi_finds_the_best_path(insults):
    """Against all readings of short tokens."""
    model = toxicity.fit(*insults).characters

    def readings(token, last=""):
        if not token:
            yield "", 0.0
            return
        c = token[0]
        options = [(c, 0.0)] if c.isalpha() else [(x, -1.0) for x in toxicity.LEET.get(c, "")] or [(c, -4.0)]
        if last and (c in toxicity.SEPARATORS or c == last):
            options = [*options, ("", -0.3 if c in toxicity.SEPARATORS else -0.2)]
        for x, cost in options:
            for rest, more in readings(token[1:], c):
                yield x + rest, cost + more

    def score(text, cost):
        s = [0, 0, *map(toxicity.sign, text), 0]
        return cost + sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))

    for token in ("m0r0n", "id1ot", "s.t.u", "looooser", "a1!b", "tr33"):
        best = max(((score(t, c), t) for t, c in readings(token) if t), key=lambda x: x[0])
        got = toxicity.decode(token, model)
        assert abs(max(score(t, c) for t, c in readings(token) if t == got) - best[0]) < 1e-9


def restorer():
    rng = random.Random(6)
    pool = "the of a house river tree stone and with such man you are idiot stupid loser moron".split()
    counts = toxicity.trigram_counts([" ".join(rng.choices(pool, k=40)) for _ in range(500)]).reshape((toxicity.SIGNS,) * 3) + 0.01
    return toxicity.Restorer(np.log(counts / counts.sum(axis=2, keepdims=True)))


def test_hidden_words_of_any_length():
    hidden = restorer()
    assert hidden.words("s" + "." * 80 + "t.u.p.i.d") == {"stupid"}
    assert "stupid" in hidden.words(" ".join("stupid" * 20))
    assert len(toxicity.decode("s" + "t" * 20_000 + "upid", hidden.model)) < 100


def test_gaps_end_words_or_do_not():
    hidden = restorer()
    assert {"stupid", "man"} <= hidden.words("such a s t u p i d man") and "astupid" not in hidden.words("such a s t u p i d man")
    assert {"you", "idiot"} <= hidden.words("y o u i d i o t")
    assert "idiot" in hidden.words("a n i d 1 0 t") and "stupid" in hidden.words("st up id") and "stupid" in hidden.words("s t u u u p i d")
    # every way to end words or not, against the search
    for run in ("a s t u", "y o u i", "of a id", "m a n 1 s"):
        pieces, best = run.split(" "), (-1e9, "")
        for mask in range(1 << (len(pieces) - 1)):
            gaps = [" " if mask >> k & 1 else "" for k in range(len(pieces) - 1)]
            for x in "il" if "1" in run else "-":
                text = "".join(p + g for p, g in zip(pieces, [*gaps, ""])).replace("1", x)
                s = [0, 0, *map(toxicity.sign, text), 0]
                cost = sum(hidden.model[a, b, c] for a, b, c in zip(s, s[1:], s[2:])) - 0.3 * len(gaps) - ("1" in run)
                best = max(best, (cost, text))
        assert toxicity.decode(run, hidden.model) == best[1]


def test_suspicion_takes_linear_time():
    import re
    import time

    old = re.compile(r"[^\W\d_].*?[0-9@$!|+(<€¡.\-_*~,'’`/\\^:;=#]|[0-9@$!|+(<€¡].*?[^\W\d_]|([^\W\d_])\1\1")
    rng = random.Random(1)
    for _ in range(20_000):
        token = "".join(rng.choice("ab_1$.-é²#]") for _ in range(rng.randint(0, 7)))
        assert toxicity.suspicious(token) == bool(old.search(token)), token
    began = time.time()
    assert not toxicity.suspicious("ab" * 500_000) and not toxicity.suspicious("1" * 500_000 + "#" * 500_000) and not toxicity.suspicious("#" * 500_000 + "]a]" + "]" * 500_000)
    assert time.time() - began < 2
    hidden = restorer()
    hidden.words("ab" * 500_000 + " " + "日本語" * 100_000)
    assert sum(map(len, hidden.known)) < 1000 and time.time() - began < 20


def test_models_do_not_share_a_scorer(insults):
    one = toxicity.fit(*insults)
    two = toxicity.ToxicModel(one.characters, {k: v + 1 for k, v in one.weights.items()}, one.bias)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.judge(insults[0], m).collect()} for m in (one, two))
    assert all(b[k] >= a[k] for k in a) and any(b[k] > a[k] + 1e-6 for k in a)


def test_toxic_labels_of_the_held_out_fold(spark, insults):
    """Accuracy on rows whose labels were never read."""
    docs, labels = insults
    got = toxicity.judge(docs, toxicity.fit(docs, labels)).filter(fold("doc_id", 3) == 1).collect()
    assert len(got) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got]) > 0.97
    lies = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.fit(docs, lies).name() == toxicity.fit(docs, labels).name()


def test_toxicity_of_awkward_texts(insults, awkward, nothing):
    docs, labels = insults
    model = toxicity.fit(docs, labels)
    got = toxicity.judge(awkward, model)
    assert got.count() == awkward.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.judge(nothing, toxicity.fit(nothing, labels)).collect() == []
    assert {r["score"] for r in toxicity.judge(awkward, toxicity.fit(awkward, labels.limit(0))).collect()} == {0.5}
    assert toxicity.fit(docs, labels.filter("toxic = 1")).bias > 0
