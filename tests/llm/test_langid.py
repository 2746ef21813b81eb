import numpy as np

from sieveline.llm import langid
from tests.llm import cases


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=4, seed=1)
    for name in ("e", "u", "w", "b"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, label = rng.integers(97, 110, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    weight = langid._letters()[windows]
    weight[2, 4:] = 0
    _, grads = net.step(windows, label, weight)
    for name, grad in zip(("e", "u", "w", "b"), grads, strict=True):
        x = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape) if name != "e" else (rng.integers(0, 2), rng.integers(97, 110), rng.integers(0, x.shape[2]))
            before, h = x[at], 1e-2
            x[at] = before + h
            up, _ = net.step(windows, label, weight)
            x[at] = before - h
            down, _ = net.step(windows, label, weight)
            x[at] = before
            assert abs((up - down) / (2 * h) - grad[at]) < 2e-4


def test_every_position_of_a_long_text_counts():
    net = langid.Network(["a", "b"], seed=2)
    text = b"abc def " * 500
    whole = net.document_probabilities([text, b"", b"xyz"])
    windows = [text[i : i + langid.WINDOW].ljust(langid.WINDOW, b"\0") for i in range(0, len(text), langid.WINDOW)]
    letter, total, seen = langid._letters(), np.zeros(2), 0
    for w in windows:
        data = np.frombuffer(w, np.uint8)[None]
        out, _ = net.states(data)
        logit = np.concatenate([out[:, 0, 0], out[:, 1, 0]], 1) @ net.w + net.b
        p = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
        total += (p * letter[data[0]][:, None]).sum(0)
        seen += letter[data[0]].sum()
    assert np.allclose(whole[0], total / seen, atol=1e-5) and (whole[1] == 0).all() and abs(whole[2].sum() - 1) < 1e-5


def test_held_out_accuracy(spark):
    words = {"en": cases.EN.split(), "fr": cases.FR.split(), "xx": [w[::-1] for w in cases.EN.split()]}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[x], 25)), x) for i in range(600) for x in [["en", "fr", "xx"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_cases(spark):
    import zlib

    docs = cases.frame(spark)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(cases.rows())
    texts = {r[0]: r[1] for r in cases.rows() if r[0] is not None}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(x.isalpha() for x in texts[r.doc_id] or ""))
            assert (r.score == 0) == (r.lang_pred == "und")
    assert langid.identify(cases.empty(spark), langid.train(cases.empty(spark))).count() == 0


def test_thresholds_keep_held_out_documents_and_doubt_the_rest(spark):
    import random
    import zlib

    rng = random.Random(4)
    words = {"en": cases.EN.split(), "fr": cases.FR.split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i in range(1200) for lang in [("en", "fr")[i % 2]]]
    others = [(5000 + i, x, None) for i, x in enumerate(["".join(rng.choice("0123456789ABCDEFabcdef") for _ in range(400)), "Привет мир это русский текст о погоде " * 5, "漢字の文章です今日は天気がいい" * 9, " ".join(rng.choice(["zażółć", "gęślą", "jaźń"]) for _ in range(60))])]
    docs = spark.createDataFrame([*rows, *others, (9000, "123", None)], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.train(docs))
    least = {r.lang_pred: r.least for r in langid.thresholds(found, docs).collect()}
    assert least.keys() == {"en", "fr"} and all(0.5 <= x <= 1 for x in least.values())
    out = {r.doc_id for r in langid.doubted(found, docs).collect()}
    clean = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert 9000 in out and len(out & set(clean)) <= 0.02 * len(clean)
    assert langid.thresholds(found.limit(0), docs).count() == 0
