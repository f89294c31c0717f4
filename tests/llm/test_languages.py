import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspan.llm import languages as L

PHRASES = {
    "en": "the {} keeps its own copy because both sides change at different times",
    "de": "der {} behält seine eigene Fassung, weil sich beide Seiten ändern",
    "nl": "de {} houdt een eigen versie omdat beide kanten veranderen",
    "fr": "le {} conserve sa propre version parce que les deux côtés changent",
    "es": "el {} mantiene su propia copia porque ambos lados cambian",
    "pl": "ten {} zachowuje własną kopię, ponieważ obie strony zmieniają się",
    "ru": "этот {} хранит свою копию, потому что обе стороны меняются",
}
NAMES = {"en": "English", "de": "German", "nl": "Dutch", "fr": "French", "es": "Spanish", "pl": "Polish", "ru": "Russian"}


def sentence(rng, code):
    return PHRASES[code].format(rng.choice(["block", "model", "app/models/a_b.rb", "`Foo::Bar`", "Foo#bar"])).capitalize() + rng.choice([".", "!"])


def test_sentences_skip_what_is_no_text():
    text = "# Heading words here now.\n\n```ruby\ndef x is not text.\n```\n- One two three. Four five six seven!\n0.95  app/a.rb:1-2\n> See app/a.b and Foo.bar now please.\nno end here at all\n\n`code only.`\n"
    found = L.sentences(text)
    assert [text[a:b] for a, b, _ in found] == ["One two three.", "Four five six seven!", "See app/a.b and Foo.bar now please."]
    assert found[2][2] == ["see", "and", "now", "please"]
    assert L.sentences("") == [] and L.sentences("\u00a0\n```\nx y z w.") == []


def test_labels(spark):
    codes = {x.lower(): c for c, n in NAMES.items() for x in (n, c)} | {"deu": "de"}
    rows = ["de", " DE ", "de-DE", "de_XX", "de-Latn", "deu", "German", "german", "", None, "und", "zxx", "??", "den", "de-", "n/a"]
    df = spark.createDataFrame([(x,) for x in rows], "l string")
    assert [r[0] for r in df.select(L.label_code(F.col("l"), codes)).collect()] == ["de"] * 8 + [None] * 6 + ["de", None]


def test_documents_with_wrong_missing_and_mixed_labels(spark):
    rng = random.Random(1)
    rows, truth, n = [], {}, 0
    for code in PHRASES:
        for _ in range(30):
            label = rng.choice([code, NAMES[code], code.upper() + "-XX"]) if rng.random() > 0.1 else rng.choice(["en", "fr", None])
            rows.append((n, " ".join(sentence(rng, code) for _ in range(rng.randint(1, 4))), label, "x"))
            truth[n] = [code]
            n += 1
    rows += [(n, sentence(rng, "en") + " " + sentence(rng, "fr") + "\n" + sentence(rng, "fr") + "\n" + sentence(rng, "en"), "en", "x"), (n + 1, None, "de", "x"), (n + 2, "", None, "x"), (n + 3, "# Only\n```\ncode here now.\n```", "??", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, code string")
    table = spark.createDataFrame([(c, c + "x", x) for c, x in NAMES.items()], "code string, code3 string, english_name string")
    got = {r["doc_id"]: r for r in L.language_segments(docs, table).collect()}
    assert len(got) == len(rows)
    right = sum([s["lang"] for s in got[k]["segments"]] == want for k, want in truth.items())
    assert right >= 0.98 * len(truth)
    assert [s["lang"] for s in got[n]["segments"]] == ["en", "fr", "en"] and got[n]["segments"][1]["sentences"] == 2
    assert all(0 <= s["confidence"] <= 1 for r in got.values() for s in r["segments"])
    assert [got[n + k]["segments"] for k in (1, 2, 3)] == [[], [], []]


def test_held_out_accuracy():
    rng = random.Random(2)
    data = [(c, L.words(sentence(rng, c))) for c in PHRASES for _ in range(40)]
    rng.shuffle(data)
    model = L.fitted_twice(data[:200])
    assert sum(model.tell(w)[0] == c for c, w in data[200:]) >= 0.98 * len(data[200:])


def test_one_machine_for_each_pair():
    model = L.Model.blank(sorted(c for codes in L.FAMILIES.values() for c in codes), dimensions=8)
    first, *inner = model.steps()
    assert model.families == ["germanic", "romance", "slavic"] and len(first.pairs) == 3
    assert [len(step.pairs) for step in inner] == [6, 6, 1] and model.weights.shape == (8, 3 + 6 + 6 + 1)
    places = [k for step in (first, *inner) for k in range(step.columns.start, step.columns.stop)]
    assert places == list(range(16))


def test_a_machine_sees_only_its_two_languages():
    own = {"en": ["the", "cat"], "de": ["die", "katze"], "nl": ["een", "poes"]}
    model = L.fitted([(c, w) for c, w in own.items() for _ in range(5)], dimensions=1 << 12)
    columns = {tuple(model.languages[k] for k in pair): model.steps()[1].first + c for c, pair in enumerate(model.steps()[1].pairs)}
    assert set(columns) == {("de", "en"), ("de", "nl"), ("en", "nl")}
    for pair, column in columns.items():
        left_out = next(c for c in own if c not in pair)
        marks = {h for w in own[left_out] for h in L.features(w, 1 << 12)} - {h for c in pair for w in own[c] for h in L.features(w, 1 << 12)}
        assert marks and not model.weights[sorted(marks), column].any()


def test_votes_ties_and_confidence():
    pairs = np.array([(0, 1), (0, 2), (1, 2)])
    best, sure = L.coupled(np.array([[1.0, 1.0, 1.0], [-1.0, -1.0, 2.0], [1.0, -2.0, 3.0], [0.0, 0.0, 0.0]]), pairs, 3)
    assert best.tolist() == [0, 1, 1, 2]  # two wins; two wins; a win each and the most margin; no margin at all: the last
    assert sure[0] > 0.8 and abs(sure[3] - 1 / 3) < 1e-9 and (sure <= 1).all()
    assert L.coupled(np.zeros((2, 0)), np.zeros((0, 2), int), 1)[1].tolist() == [1.0, 1.0]


def test_sentences_of_other_scripts():
    text = "这个模块保留自己的副本。那个方法没有人用！\nयह खंड अपनी प्रति रखता है। वह दूसरा है अब।\nโมดูลนี้เก็บสำเนาของตัวเอง\n「彼は古い写しを使う。」次の版で消える。\n"
    assert [text[a:b] for a, b, _ in L.sentences(text)] == [
        "这个模块保留自己的副本。", "那个方法没有人用！", "यह खंड अपनी प्रति रखता है।", "वह दूसरा है अब।", "โมดูลนี้เก็บสำเนาของตัวเอง", "「彼は古い写しを使う。」", "次の版で消える。",
    ]
    assert L.words("那个方法。") == ["那个", "个方", "方法"]


def test_unlisted_languages_join_their_script():
    own = {"el": ["αυτό", "το", "κείμενο"], "bg": ["този", "текст", "е"], "uk": ["цей", "текст", "є"], "fi": ["tämä", "teksti", "on"]}
    model = L.fitted([(c, w) for c, w in own.items() for _ in range(5)], dimensions=1 << 12)
    assert model.families == ["script Cyrillic", "script Greek", "script Latin"]
    assert [model.tell(w)[0] for w in own.values()] == list(own)


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_CODES", 2)
    with pytest.raises(ValueError):
        L.known_codes(spark.createDataFrame([(str(k), None, None) for k in range(3)], "code string, code3 string, english_name string"))
    monkeypatch.setattr(L, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        L.Model.blank(["de", "en"], dimensions=1 << 12)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "One two three.", None)], "doc_id bigint, text string, lang string")
    table = spark.createDataFrame([("en", "eng", "English")], "code string, code3 string, english_name string")
    assert [r["segments"] for r in L.language_segments(docs, table).collect()] == [[]]
    assert L.language_segments(docs.limit(0), table).count() == 0
