import math

import numpy as np
from pyspark.sql import functions as F

from sluice.llm.langid import ORDER, calibrate, code_lengths, decide, fit, label_language, label_paragraphs, prose, purify, train

EN = ["the player shows the next window of the stream", "please check whether the origin keeps the old time", "we saw that the encoder writes a gap after the break", "nobody knows why the window of the manifest is empty", "the segment list was written before the period ends"]
DE = ["der spieler zeigt das nächste fenster des stroms", "bitte prüfen ob die quelle die alte zeit behält", "wir sehen dass der kodierer eine lücke nach der pause schreibt", "niemand weiß warum das fenster des manifests leer ist", "die segmentliste wurde vor dem ende der periode geschrieben"]
RU = ["плеер показывает следующее окно потока", "пожалуйста проверьте хранит ли источник старое время", "мы видели что кодер пишет разрыв после паузы", "никто не знает почему окно манифеста пустое"]


def slow_bits(texts, block):
    """The same code lengths from plain dictionaries."""
    counts = {}
    pad = b"\n" * (ORDER + 1)
    data = pad
    spans = []
    for t in texts:
        spans.append((len(data), len(data) + len(t.encode())))
        data += t.encode() + pad
    for a, b in spans:
        for i in range(a, b):
            for k in range(ORDER + 1):
                c = counts.setdefault(data[i - k : i] if k else b"", {})
                c[data[i]] = c.get(data[i], 0) + 1
    data = pad + block.encode()
    total = 0.0
    for i in range(len(pad), len(data)):
        for k in range(ORDER, -1, -1):
            c = counts.get(data[i - k : i] if k else b"")
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if data[i] in c:
                total += math.log2((n + d) / c[data[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_the_context_tree():
    model = train({"en": EN, "de": DE})
    blocks = ["the window", "das fenster", "ünknown ÿÿ", "x"]
    fast = code_lengths(model, blocks)
    for i, b in enumerate(blocks):
        assert np.allclose(fast[i], [slow_bits(DE, b), slow_bits(EN, b)], rtol=1e-4), b
    assert np.allclose(code_lengths(model, blocks, at_once=1), fast)


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-GB": "en", "en_US": "en", "eng": "en", "English": "en", " German ": "de", "deu": "de", "ger": "de", "日本語": "ja", "sv": "sv", "zh-Hant-TW": "zh", "norwegian": "no", "nor": "no", "ron": "ro", "rum": "ro", "Ελληνικά": "el", "Greek": "el", "heb": "he", "iw": "he", "hindi": "hi", "Englisch": "en", "anglais": "en", "Français": "fr", "xx": None, "und": None, "unknown": None, "": None, None: None, "e": None}
    df = spark.createDataFrame([(k,) for k in cases], "lang string")
    assert {r.lang: r.code for r in df.select("lang", label_language(F.col("lang")).alias("code")).collect()} == cases


def test_other_scripts_and_repeats():
    """Prose in a script that no label has is in none of the languages; a wrong label that comes twice is still found out."""
    model = train({"en": EN, "de": DE})
    assert decide(model, ["ο παίκτης δείχνει το επόμενο παράθυρο", EN[0], EN[0]])[0][0] is None
    assert [x[0] for x in decide(model, [EN[0], "", EN[0]])] == ["en", None, "en"]
    texts = {"en": EN * 3, "de": DE * 3 + [EN[1], EN[1], EN[2][:40]]}
    kept = purify(texts)
    assert not set(kept["de"]) & {*EN, EN[2][:40]} and kept["de"] and kept["en"]
    assert 0.005 <= calibrate(kept) <= 1


def test_prose():
    for block in ('<S t="1" d="2"/>\n<S t="3"/>', '{"a": ["text here"]}', "12 345\n6", "", "\n", "---", "`code here`", "https://a.example/x"):
        assert prose(block) == "", block
    assert prose("Siehe [Event/@id] und `x y` 12") and "siehe" in prose("Siehe <b>x</b>")
    assert prose("[not json at all]") and prose("{" * 5000) == ""


def test_documents(spark):
    rows = [(i, t, lang, "p") for i, (t, lang) in enumerate([(x, "en") for x in EN] + [(x, "German") for x in DE] + [(x, "rus") for x in RU])]
    rows += [(i + 100, t, "de", "p") for i, t in enumerate(EN[:1])]  # a wrong label
    train_on = spark.createDataFrame(rows, "doc_id long, text string, lang string, para string")
    model = fit(train_on, per_language=100)
    assert model.languages == ["de", "en", "ru"]
    text = "please check the window of the origin\n\n<S t='1'/>\n\nbitte prüfen warum das fenster leer ist\n\nпочему окно пустое\n\n"
    docs = [(1, text, "en"), (2, None, "en"), (3, "", "en"), (4, "the window of the player " * 20_000, None), (5, "1 2 3", "und")]
    got = {r.doc_id: r for r in label_paragraphs(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model).collect()}
    assert [p.lang for p in got[1].paragraphs] == ["en", None, "de", "ru", None] and [p.para for p in got[1].paragraphs] == [0, 1, 2, 3, 4]
    assert all(0.5 < p.confidence <= 1 for p in got[1].paragraphs if p.lang) and got[1].paragraphs[1].confidence == 0
    assert got[2].paragraphs == [] and [p.lang for p in got[3].paragraphs] == [None] and got[4].paragraphs[0].lang == "en" and got[4].label is None
    assert got[5].paragraphs[0].lang is None
    empty = fit(train_on.limit(0))
    assert decide(empty, ["text"]) == [(None, 0.0, 0)]
    assert label_paragraphs(train_on.limit(0), model).count() == 0


def test_held_out(spark):
    """Trained on half of the sentences with a tenth of wrong labels, right on the other half."""
    import random

    rng = random.Random(2)
    parts = {"en": ("the old client the player our encoder".split(" the "), ["shows a gap", "loses two segments", "asks for the wrong range"], ["after the restart", "during the night", "without any reason"]), "de": (["der alte client", "der spieler", "unser kodierer"], ["zeigt eine lücke", "verliert zwei segmente", "fragt den falschen bereich ab"], ["nach dem neustart", "in der nacht", "ohne jeden grund"]), "nl": (["de oude client", "de speler", "onze encoder"], ["toont een gat", "verliest twee segmenten", "vraagt het verkeerde bereik"], ["na de herstart", "in de nacht", "zonder enige reden"])}
    sentence = lambda lang: " ".join(rng.choice(p) for p in parts[lang])
    rows = [(i, " ".join(sentence(lang) for _ in range(4)), lang if rng.random() > 0.1 else rng.choice("en de nl".split())) for i, lang in enumerate(list(parts) * 60)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(lang, sentence(lang)) for lang in parts for _ in range(50)]
    right = sum(got[0] == lang for (lang, _), got in zip(tests, decide(model, [t for _, t in tests])))
    assert right >= 0.98 * len(tests)
