"""Look-alikes, overlaps, leaks, mixtures, languages."""

import random
import re
import textwrap
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.functions.edits import distances
from voxloom.llm import fmindex, labels, language, leaks, lookalike, mixing, overlap
from voxloom.operators import spread

from .sentences import SENTENCES, documents


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


RUN = lookalike.transducer().run


@pytest.mark.parametrize(
    "a,b",
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ，１", "full width,1"),
        ("Café", "Café"),
        ("ậ", "ậ"),
        ("ậ", "ậ"),
        ("cafe​́", "café"),
        ("so­ft‍ ﻿x", "soft x"),
        ("no break space x", "no break space x"),
        ("Аmѕtеrdаm", "Amsterdam"),
        ("ﬁn ﬂow zalĳ", "fin flow zalij"),
        (" a  b ", "a b"),
        ("ό", "ó"),
        ("ｶﾞ", "ガ"),
    ],
)
def test_same_look(a, b):
    assert RUN(a) == RUN(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("a.", "a"), ("a b", "ab"), ("x²", "x2"), ("ß", "ss"), ("a-b", "a–b"), ("½", "1/2"), ("ñ", "n")])
def test_other_look(a, b):
    assert RUN(a) != RUN(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_fixed_points(t):
    form = RUN(t)
    assert RUN(form) == form
    assert RUN(unicodedata.normalize("NFD", t)) == RUN(unicodedata.normalize("NFC", t))


def test_conflicting_rules(monkeypatch):
    monkeypatch.setattr(lookalike, "LOOKALIKES", "а a  а o")
    with pytest.raises(ValueError):
        lookalike.LookTransducer()


def test_look_pairs(spark):
    data = [(1, "Amber een"), (2, "Аmber een"), (3, "Amber een"), (4, "Amber een"), (5, "amber een"), (6, None), (7, " ​"), (8, ""), (9, "x"), (None, "ｘ"), (10, "ｘ")]
    df = spark.createDataFrame([(i, t, "f") for i, t in data], "id int, text string, form string")
    got = lookalike.same_look_pairs(df, "id", "text")
    assert got.columns == ["id_a", "id_b"]
    assert rows(got) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (9, 10)]
    assert rows(lookalike.same_look_pairs(df.limit(0), "id", "text")) == []
    assert lookalike.with_form(spark.createDataFrame([("y" * 500_000 + " ",)], "text string"), "text").select(F.length("form")).first()[0] == 500_000


def brute_overlaps(data):
    word = re.compile(r"[^\W_]+")
    split = defaultdict(list)
    for i, t, s in data:
        ws = word.findall((t or "").lower())
        if i is not None and ws and s in ("train", "validation", "test"):
            split["train" if s == "train" else "held"].append((i, ws))
    out = set()
    for i, a in split["held"]:
        for j, b in split["train"]:
            if 5 * int(distances([a], [b])[0]) <= max(len(a), len(b)):
                out.add((min(i, j), max(i, j)))
    return out


def overlap_data(seed, n=140, vocabulary=60, longest=24):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(6)]
    data = []
    for i in range(n):
        if data and rng.random() < 0.6:
            ws = (rng.choice(data)[1] or "x").split()
            for _ in range(rng.randrange(0, max(1, len(ws) // 4) + 1)):
                k = rng.randrange(len(ws) + 1)
                kind = rng.random()
                if kind < 0.4 and k < len(ws):
                    ws[k] = rng.choice(common)
                elif kind < 0.7 and len(ws) > 1:
                    del ws[min(k, len(ws) - 1)]
                else:
                    ws.insert(k, f"w{rng.randrange(vocabulary)}")
        else:
            ws = [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, longest))]
        data.append((i, " ".join(ws), rng.choice(["train", "train", "validation", "test", None])))
    data += [(n + 10 + k, "c1 w1 w2 w3 c2 w4", "test" if k % 3 else "train") for k in range(45)]
    return [*data, (n, None, "train"), (n + 1, "?!", "test"), (n + 2, "", "train"), (None, "c1", "test")]


@pytest.mark.parametrize("seed,kwargs,rare", [(1, {}, 4.0), (2, {"vocabulary": 4}, 0.01), (3, {"vocabulary": 300, "longest": 90, "n": 80}, 0.5), (4, {"vocabulary": 2, "longest": 9}, 4.0)])
def test_overlaps(spark, monkeypatch, seed, kwargs, rare):
    monkeypatch.setattr(overlap, "RARE", rare)
    monkeypatch.setattr(spread, "HOT_LEAST", 10)
    data = overlap_data(seed, **kwargs)
    df = spark.createDataFrame([(i, t, s, 0) for i, t, s in data], "sample_index int, text string, split string, edits int")
    found = overlap.Overlaps(df)
    pairs = rows(found.pairs().select("id_a", "id_b"))
    assert set(pairs) == brute_overlaps(data) and len(pairs) == len(set(pairs))
    held = {i: s for i, _, s in data}
    touched = {r["_id"] for r in found.touched().collect()}
    assert touched == {x for p in pairs for x in p if held[x] in ("validation", "test")}


@pytest.mark.parametrize("seed,length", [(5, 300), (6, 60), (7, 210)])
def test_shingles_of_long_texts_meet(seed, length):
    """Texts of any length within the bound share a key."""
    rng = random.Random(seed)
    for turn in range(40):
        a = [rng.randrange(1, 40 if turn % 2 else 4000) for _ in range(length)]
        b = list(a)
        for _ in range(length // 5):
            kind, k = rng.random(), rng.randrange(len(b))
            if kind < 0.4:
                b[k] = rng.randrange(1, 4000)
            elif kind < 0.7:
                del b[k]
            else:
                b.insert(k, rng.randrange(1, 40))
        if 5 * int(distances([a], [b])[0]) > max(len(a), len(b)):
            continue
        counts = np.ones(overlap.SKETCH, np.int32)
        counts[1:40] = 500
        made = overlap.Shingles(counts, 1000)
        text, key, _, _ = made.of(np.array(a + b, np.int64), np.array([0, len(a), len(a) + len(b)], np.int64))
        assert set(key[text == 0]) & set(key[text == 1])


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "sample_index int, text string, split string")
    assert overlap.Overlaps(df).pairs().count() == 0
    one = spark.createDataFrame([(1, "a b c", "train"), (2, "A, b c.", "test"), (2, "A, b c.", "test"), (3, "x " * 20_000, "test")], "sample_index int, text string, split string")
    assert rows(overlap.Overlaps(one).pairs()) == [(1, 2, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=1, max_size=8))
def test_fm_index(seq, patterns):
    index = fmindex.FMIndex(np.array(seq, np.int64), 4, every=3)
    lo, hi = index.search(np.array(patterns, np.int64))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        expected = [i for i in range(len(seq)) if seq[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_leaks(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[4:20])), (3, "too short"), (4, None), (5, " ".join(w[:12]).upper())]
    docs = [
        (10, "\u0130x. Intro! " + ", ".join(w[:8]) + ". end"),
        (11, " ".join(w[:7]) + " nope " + " ".join(w[7:14])),
        (12, "x " + " ".join(w[2:18]) + " y " + " ".join(w[:9])),
        (13, None),
        (14, ""),
        (15, "w0 " * 50),
        (16, " ".join(w[:8])),
        (17, " ".join(w[:4])),
        (18, " ".join(w[4:12])),
    ]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id int, text string, start int, words int").coalesce(1)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks.leaked_spans(i, d)
    pairs = {(r["item_id"], r["doc_id"]) for r in got.collect()}
    assert pairs == {(1, 10), (5, 10), (1, 12), (2, 12), (5, 12), (1, 16), (5, 16), (1, 18), (2, 18), (5, 18)}
    texts = dict(docs)
    spans = {(r["item_id"], r["doc_id"]): texts[r["doc_id"]][r["start"] : r["end"]] for r in got.where("doc_id = 10 OR doc_id = 18").collect()}
    assert spans[1, 10] == ", ".join(w[:8]) and spans[2, 18] == " ".join(w[4:12])
    assert sorted(r["words"] for r in got.where("item_id = 1 AND doc_id = 12").collect()) == [9, 10]
    assert leaks.leaked_spans(i.limit(0), d).count() == 0 and leaks.leaked_spans(i, d.limit(0)).count() == 0


def test_leak_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 30)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(texts[:6])), "item_id int, text string")
    docs = spark.createDataFrame([*enumerate(texts[3:]), *((100 + k, f"a {t} b") for k, t in enumerate(texts[:9]))], "doc_id int, text string")

    def grams(t):
        ws = t.split()
        return {tuple(ws[k : k + 8]) for k in range(len(ws) - 7)}

    expected = {(i["item_id"], d["doc_id"]) for i in items.collect() for d in docs.collect() if grams(i["text"]) & grams(d["text"])}
    assert {(r["item_id"], r["doc_id"]) for r in leaks.leaked_spans(items, docs).collect()} == expected


def test_plan_moves_shortages_to_siblings_first():
    leaves = [("d", "en", "d_a", 100), ("d", "en", "d_b", 1000), ("d", "nl", "d_c", 1000), ("e", "en", "e_a", 1000)]
    targets = {"d_a": (0.25, 1), "d_b": (0.25, 1), "d_c": (0.25, 1), "e_a": (0.25, 1), "gone": (0.0, 1)}
    got = mixing.plan(leaves, targets, 1600)
    assert got == {("d", "en", "d_a"): 100, ("d", "en", "d_b"): 700, ("d", "nl", "d_c"): 400, ("e", "en", "e_a"): 400}
    more = mixing.plan(leaves, targets, 3000)  # the domain fills up, then the other domain
    assert more[("d", "en", "d_a")] == 100 and more[("d", "en", "d_b")] == 1000 and sum(more.values()) == 3000
    assert mixing.plan(leaves, targets, 10_000) == {k[:3]: k[3] for k in leaves}
    assert mixing.plan([], {}, 5) == {}
    absent = mixing.plan([("d", "en", "d_a", 100)], {"d_a": (0.5, 3), "x": (0.5, 1)}, 200)
    assert absent == {("d", "en", "d_a"): 200}


def test_mixture(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(1, 30))), rng.choice(["en", "English ", None]), rng.choice(["x_a", "X_A ", "x_b", "y_c", None])) for i in range(200)]
    docs += [(1000, None, "en", "x_a"), (1001, "", "en", "x_a")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id int, text string, lang string, source string, tokens int, epoch int")
    targets = spark.createDataFrame([("x_a", 0.6, 3), ("x_b", 0.3, 3), ("Y_C", 0.1, 3), ("none_z", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mixture(df, targets, total=8000)
    report = {r["source"]: r for r in mix.report.collect()}
    assert sum(r["taken_tokens"] for r in report.values()) == pytest.approx(8000, abs=5)
    for s, share in (("x_a", 0.6), ("x_b", 0.3), ("y_c", 0.1)):
        assert report[s]["actual_share"] == pytest.approx(share, abs=0.002) and report[s]["epochs"] <= 3
    chosen = [tuple(r) for r in mix.selection.collect()]
    assert len({(c[0], c[3]) for c in chosen}) == len(chosen) and all(0 < c[5] <= c[4] for c in chosen)
    full = Counter()
    for c in chosen:
        full[c[1], c[2], c[3]] += c[5] < c[4]
    assert max(full.values()) <= 1  # at most one document of a leaf's epoch is cut
    assert rows(mixing.Mixture(df, targets, total=8000).selection) == sorted(chosen, key=repr)
    empty = mixing.Mixture(df.limit(0), targets)
    assert empty.selection.count() == 0 and {r["actual_share"] for r in empty.report.collect()} == {None}
    assert mixing.Mixture(df, targets.limit(0)).selection.count() == 0


def test_labels(spark):
    given_ = {"NL": "nl", " nl_BE": "nl", "Dutch": "nl", "pt-BR": "pt", "Português": "pt", "eng": "en", "zh": None, "und": None, "mul": None, "": None, "??": None, "n/a": None, "English (UK)": "en", "fr-CA": "fr", "xx-nl": None}
    df = spark.createDataFrame([(k,) for k in given_], "l string").select("l", labels.language_of_label(F.col("l")).alias("x"))
    assert dict(df.collect()) == given_


LINES = {
    "en": "the quick brown fox jumps over the lazy dog while many children were watching|she would like to have another cup of tea with them|there was nothing that we could do about the weather",
    "nl": "de snelle bruine vos springt over de luie hond terwijl veel kinderen keken|zij zou graag nog een kopje thee met hen willen drinken|er was niets dat wij aan het weer konden doen",
    "de": "der schnelle braune fuchs springt über den faulen hund während viele kinder zusahen|sie möchte gerne noch eine tasse tee mit ihnen trinken|es gab nichts was wir gegen das wetter tun konnten",
}


def sentences(lang, n, seed):
    rng = random.Random(seed)
    pool = [w for s in LINES[lang].split("|") for w in s.split()]
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(8, 15))).capitalize() + "." for _ in range(n)]


def test_code_lengths_are_a_distribution():
    """In every context the probabilities of seen bytes and the escape sum to 1 in each language."""
    trees = language.ContextTrees({x: Counter(" ".join(LINES[x].split("|")).split()) for x in LINES})
    for j in range(len(trees.languages)):
        for context in (b"", b" ", b" d", b"e"):
            at = trees.escape_at[context]
            if trees.escapes[at, j] == 0:
                continue
            escape = 2.0 ** -float(trees.escapes[at, j])
            seen = 0.0
            for symbol in range(256):
                row = trees.cost_at.get(context + bytes((symbol,)))
                below = trees.cost_at.get(context[1:] + bytes((symbol,))) if context else None
                if row is None:
                    continue
                p = 2.0 ** -float(trees.costs[row, j])
                back = escape * 2.0 ** -(float(trees.costs[below, j]) if below is not None else 8.0)
                if abs(p - back) > 1e-4 * p:
                    seen += p
            assert seen + escape == pytest.approx(1.0, rel=1e-3)


def test_languages(spark):
    docs = []
    for k, lang in enumerate(LINES):
        docs += [(100 * k + i, " ".join(sentences(lang, 6, 100 * k + i)), lang) for i in range(20)]
    mixed = sentences("en", 3, 1) + sentences("de", 3, 2)
    phrase = [*sentences("en", 3, 3), *sentences("nl", 1, 4), *sentences("en", 3, 5)]
    docs += [
        (900, " ".join(mixed), "en"), (901, "\n".join(phrase), "en"), (902, sentences("nl", 1, 6)[0], "German"),
        (903, sentences("de", 1, 7)[0], None), (904, None, "en"), (905, "12 !?", "en"), (906, "", "nl"), (907, " ".join(sentences("nl", 3000, 8)), "Dutch"),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id int, text string, lang string, seg_no int")
    found = language.language_stretches(df)
    got = defaultdict(list)
    for r in found.orderBy("doc_id", "seg_no").collect():
        got[r["doc_id"]].append((r["seg_no"], r["lang"]))
        assert 0 < r["confidence"] <= 1 and r["start"] < r["end"]
    for k, lang in enumerate(LINES):
        assert all(got[100 * k + i] == [(0, lang)] for i in range(20))
    assert got[900] == [(0, "en"), (1, "de")] and got[901] == [(0, "en")] and got[902] == [(0, "nl")] and got[903] == [(0, "de")] and got[907] == [(0, "nl")]
    assert not {904, 905, 906} & set(got)
    assert {r["doc_id"] for r in language.mislabelled(found).collect()} == {900, 902, 903}
    assert language.language_stretches(df.limit(0)).count() == 0
    assert language.language_stretches(df.withColumn("lang", F.lit("?"))).count() == 0


def test_stretches():
    def bits(*langs):
        return np.array([[0.0 if k == x else 150.0 for k in range(3)] for x in langs])

    assert language.stretches(bits(0, 0, 1, 1)) == [(0, 2, 0), (2, 4, 1)]
    assert language.stretches(bits(0, 0, 1, 0, 0)) == [(0, 5, 0)]
    assert language.stretches(bits(0, 1, 1)) == [(0, 3, 1)]
    assert language.stretches(bits(2)) == [(0, 1, 2)]
    assert language.stretches(bits(0, 0, 1, 1, 1, 0, 0)) == [(0, 2, 0), (2, 5, 1), (5, 7, 0)]


@pytest.mark.parametrize("a,b", [("\u2163", "IV"), ("\u217a x", "xi x"), ("\u0149", "\u02bcn"), ("\u0587", "\u0565\u0582"), ("\u0555h", "Oh"), ("\u13aa\u13ac", "AE"), ("\u13a1\u13da", "R\u13da"), ("\u13ab", "J")])
def test_same_look_of_numerals_and_other_scripts(a, b):
    assert RUN(a) == RUN(b)


def pieces(text):
    return [text[a:b] for a, b, _ in language.units_of(text)]


def test_short_sentences_are_units():
    assert pieces("Vem cá. Não sei! Onde estás agora?") == ["Vem cá.", "Não sei!", "Onde estás agora?"]
    assert pieces("# Kop v1.2\n\nopen de deur\nsluit het raam\nwacht op mij\n") == ["# Kop v1.2\n\nopen de deur", "sluit het raam", "wacht op mij"]
    loose = textwrap.wrap(" ".join(["der alte mann ging mit dem hund zum markt und kaufte dort kein brot"] * 3), 16)
    assert len(pieces("\n".join(loose))) > 4 and all(len(x.split()) >= language.LEAST_WORDS for x in pieces("\n".join(loose)))
    # quoted phrases, headings and pieces of sentences belong to a neighbour
    assert pieces('Ik kom morgen. "push to talk" Ga maar zitten.') == ["Ik kom morgen.", '"push to talk" Ga maar zitten.']
    assert pieces("Zij las een heel oude brief, ... Toen niets. Nee.") == ["Zij las een heel oude brief, ... Toen niets.", "Nee."]
    assert pieces("Dr. Jansen belt. Hij las, ... Toen niets. Nee.") == ["Dr. Jansen belt.", "Hij las, ... Toen niets.", "Nee."]


@pytest.mark.parametrize("width", [16, 30, 60])
def test_wrapped_lines_are_joined(width):
    whole = ["The old man went to the market with his dog and Anna.", "He bought nothing.", "Der Hund lief mit dem Kind über die Straße nach Hause.", "Es regnete den ganzen Tag."]
    for indent in ("", "  "):
        text = "\n".join(indent + x for x in textwrap.wrap(" ".join(whole), width))
        assert [" ".join(x.split()) for x in pieces(text)] == whole
        assert [" ".join(x.split()) for x in pieces(text.replace("\n", " \r\n"))] == whole
    apart = "\n\n".join(f"- {x}" for x in whole)
    assert [x.lstrip("- ") for x in pieces(apart)] == whole


NEAR = {
    "es": "el vecino callado abrió la ventana por la noche|ella no tiene mucho tiempo para hablar con ellos|los niños jugaron ayer en el jardín de la escuela|hoy hace muy buen tiempo y quiero salir a pasear|¿dónde están las llaves de mi coche nuevo?|nosotros fuimos juntos al cine después de comer",
    "pt": "o vizinho calado abriu a janela durante a noite|ela não tem muito tempo para falar com eles|as crianças brincaram ontem no jardim da escola|hoje faz muito bom tempo e quero sair a passear|onde estão as chaves do meu carro novo?|nós fomos juntos ao cinema depois de comer",
}


def near_sentences(lang):
    return [x[0].upper() + x[1:] + ("" if x.endswith("?") else ".") for x in NEAR[lang].split("|")]


def test_two_short_sentences_of_a_near_language():
    es, pt = near_sentences("es"), near_sentences("pt")
    trees = language.fit([(lang, " ".join(near_sentences(lang))) for lang in NEAR for _ in range(5)])

    def found(text):
        units = language.units_of(text)
        return [(trees.languages[k], text[units[a][0] : units[b - 1][1]]) for a, b, k in language.stretches(next(language.Scorer(trees).units([units])))]

    two = "Hoje não quero. Onde estão as crianças?"
    assert found(" ".join([*es[:4], two, *es[2:]])) == [("es", " ".join(es[:4])), ("pt", two), ("es", " ".join(es[2:]))]
    assert found(" ".join([*es, two])) == [("es", " ".join(es)), ("pt", two)]
    wrapped = textwrap.fill(" ".join([*es[:4], *pt[1:3], *es[3:]]), 24)
    assert [x for x, _ in found(wrapped)] == ["es", "pt", "es"]
    assert [x for x, _ in found("\n".join(["el vecino callado", "por la noche", "no tiene tiempo", "o vizinho calado", "ela não tem muito tempo", "abriu a janela"]))] == ["es", "pt"]
    # one sentence, or a phrase, isn't a stretch; nor is a text of one language ever divided
    assert [x for x, _ in found(" ".join([*es[:4], pt[0], *es[2:]]))] == ["es"]
    assert [x for x, _ in found(" ".join(es * 40))] == ["es"]


def test_stretches_of_40_bits_a_sentence():
    def bits(*langs):
        return np.array([[0.0 if k == x else 40.0 for k in range(3)] for x in langs])

    assert language.stretches(bits(0, 0, 1, 1)) == [(0, 2, 0), (2, 4, 1)]
    assert language.stretches(bits(0, 0, 1, 0, 0)) == [(0, 5, 0)]
    assert language.stretches(bits(0, 0, 1, 1, 1, 0, 0)) == [(0, 2, 0), (2, 5, 1), (5, 7, 0)]
    assert language.stretches(bits(0, 0, 0, 1, 1, 0, 0, 0)) == [(0, 3, 0), (3, 5, 1), (5, 8, 0)]


def test_long_labelled_documents_are_sampled(spark):
    """A language whose labelled documents are all long is in the model, of each of them an excerpt."""
    long = {lang: ["1 " * 5000 + " ".join(sentences(lang, 300, 7 * k + i)) for i in range(5)] for k, lang in enumerate(LINES)}
    docs = [(10 * k + i, t, lang) for k, lang in enumerate(LINES) for i, t in enumerate(long[lang] if lang == "de" else sentences(lang, 5, k))]
    df = spark.createDataFrame([*docs, (100, " ".join(sentences("de", 2, 99)), "en")], "doc_id int, text string, lang string")
    with pytest.warns(UserWarning, match="no labelled sample of .*pt"):
        found = language.language_stretches(df)
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == {**{i: lang for i, _, lang in docs}, 100: "de"}
    only = df.where("length(text) > 8000")
    assert {r["doc_id"]: r["lang"] for r in language.language_stretches(only).collect()} == {i: lang for i, t, lang in docs if len(t) > 8000}
    assert all(len(language.excerpt(t[10000:])) <= language.SAMPLE_CHARS and language.excerpt(t[10000:]).endswith(".") for t in long["de"])
    assert len(language.excerpt("word " * 3000)) == language.SAMPLE_CHARS and len(language.excerpt("x" * 9000)) == language.SAMPLE_CHARS


def every_division(bits):
    """The least cost of all divisions into stretches of two units at least, each in one language, neighbours in different ones."""
    count, width = bits.shape
    cost = language.change_bits(count, width)
    best = {}  # (units done, language of the last stretch) -> cost

    def least(done, last):
        if done == count:
            return 0.0
        if (done, last) not in best:
            options = [np.inf]
            for end in range(done + 2, count + 1):
                for lang in range(width):
                    if lang != last:
                        options.append(bits[done:end, lang].sum() + (cost if done else 0.0) + least(end, lang))
            best[done, last] = min(options)
        return best[done, last]

    return bits.sum() if count == 1 else least(0, -1)


def test_stretches_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(300):
        bits = rng.exponential(12.0, (int(rng.integers(2, 9)), 3))
        found = language.stretches(bits)
        assert found[0][0] == 0 and found[-1][1] == len(bits) and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(found, found[1:]))
        assert all(b - a >= 2 for a, b, _ in found) or len(found) == 1
        cost = sum(bits[a:b, lang].sum() for a, b, lang in found) + language.change_bits(*bits.shape) * (len(found) - 1)
        assert cost == pytest.approx(every_division(bits))


def test_code_lengths_by_counting():
    """Each byte's cost from the counts of its contexts, the longest first, escapes by the number of different bytes seen."""
    words = Counter("de hond ziet de andere hond bij het huis hondje".split())
    trees = language.ContextTrees({"nl": words, "en": Counter(["the", "dog"])})
    seen = defaultdict(Counter)
    for w, times in words.items():
        coded = f" {w} ".encode()
        for at in range(1, len(coded)):
            for k in range(min(language.ORDER, at) + 1):
                seen[coded[at - k : at]][coded[at]] += times

    def cost(coded, at):
        bits = 0.0
        for k in range(min(language.ORDER, at), -1, -1):
            here = seen.get(coded[at - k : at])
            if here:
                n, q = sum(here.values()), len(here)
                if coded[at] in here:
                    return bits + np.log2((n + q) / here[coded[at]])
                bits += np.log2((n + q) / q)
        return bits + 8.0

    for w in ("hond", "hondenhok", "zien", "é", "xyz"):
        coded = f" {w} ".encode()
        assert trees.word_bits(w)[trees.languages.index("nl")] == pytest.approx(sum(cost(coded, at) for at in range(1, len(coded))), rel=1e-5)


@pytest.fixture(scope="module")
def fitted_trees(spark):
    """The model of the labelled documents of a table that no sentence below is taken from."""
    return language.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text", "lang", "doc_id")


def divided(trees, texts):
    units = [language.units_of(t) for t in texts]
    scorer = language.Scorer(trees)
    for mine, bits in zip(units, scorer.units(units), strict=True):
        yield [(a, b, trees.languages[k], language.confidence(bits[a:b].sum(axis=0), k, trees.temper)) for a, b, k in language.stretches(bits)]


@pytest.mark.parametrize("pair", [("es", "pt"), ("nl", "de"), ("en", "nl"), ("fr", "es"), ("de", "en"), ("pt", "fr")])
def test_invented_documents(fitted_trees, pair):
    """Recall and precision of stretches with exact borders, in documents of two languages made of invented sentences."""
    hit = wanted = got = 0
    for shape in ((2, 2), (3, 3), (2, 2, 2), (5, 2, 4), (6, 3), (8,)):
        made = documents(pair, shape, 40)
        for (_, parts), found in zip(made, divided(fitted_trees, [t for t, _ in made]), strict=True):
            ends = np.cumsum([n for _, n in parts])
            truth = {(int(e) - n, int(e), lang) for e, (lang, n) in zip(ends, parts, strict=True)}
            hit += len(truth & {x[:3] for x in found})
            wanted, got = wanted + len(truth), got + len(found)
    assert hit / wanted >= 0.9 and hit / got >= 0.9


def test_confidence_is_a_frequency(fitted_trees):
    """Of single invented sentences about as many have the found language as the confidence says."""
    lone = [(lang, s) for lang, every in SENTENCES.items() for s in every]
    sure = [(found[0][3], found[0][2] == lang) for (lang, _), found in zip(lone, divided(fitted_trees, [s for _, s in lone]), strict=True)]
    assert abs(np.mean([c for c, _ in sure]) - np.mean([ok for _, ok in sure])) <= 0.08
    low = [ok for c, ok in sure if c < 0.9]
    high = [ok for c, ok in sure if c >= 0.9]
    assert np.mean(high) >= 0.9 and (not low or np.mean(low) < np.mean(high))


@pytest.mark.parametrize("temper", [2.0, 16.0])
def test_the_temper_is_found(temper):
    rng = np.random.default_rng(5)
    bits = rng.exponential(30.0, (4000, 4))
    odds = np.exp2(-bits / temper)
    own = np.array([rng.choice(4, p=p) for p in odds / odds.sum(axis=1, keepdims=True)])
    own[:80] = rng.integers(0, 4, 80)  # strays
    assert temper / 1.5 <= language.fitted_temper(bits, own) <= temper * 1.5


@pytest.mark.parametrize(
    "a,b",
    [
        ("ⅼ", "l"), ("Ⅰ", "I"), ("օ", "o"), ("ո", "n"), ("ս", "u"), ("Ꭺ", "A"), ("ꓮꓲ", "AI"), ("ѵ", "v"), ("1∕2", "1/2"), ("Ⲟⲟ", "Oo"),
        ("ö\u0338", "ø\u0308"), ("d\u0335", "đ"), ("L\u0337", "Ł"), ("i\u0307", "i"), ("ı\u0307", "i"), ("ȷ\u0307k", "jk"), ("ı\u0301", "í"),
        ("а\u0301", "á"), ("o\u0338\u0301", "ǿ"), ("ｄ\u0335", "đ"), ("f\u200ci", "fi"), ("a\u200db", "ab"), ("ﻻ", "لا"), ("각", "\u1100\u1161\u11a8"),
        ("سلام\u200c", "سلام"), ("ا\u200cب", "اب"), ("☃\ufe0f", "☃"), ("x\U000e0067y", "xy"),
    ],
)
def test_one_look(a, b):
    assert RUN(a) == RUN(b)


@pytest.mark.parametrize("mark", "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
def test_visible_format_marks_stay(mark):
    assert mark in RUN(f"a{mark}b") and RUN(f"a{mark}b") != RUN("ab")


@pytest.mark.parametrize(
    "a,b",
    [
        ("می\u200cخواهم", "میخواهم"), ("क्\u200dष", "क्ष"), ("क्\u200cष", "क्ष"), ("ه\u200d", "ه"), ("👩\u200d💻", "👩💻"), ("i\u0307\u0301", "í"), ("o\u0338", "o"),
        ("a\u202eb", "ab"), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4"), ("І", "l"), ("ӏ", "I"),
    ],
)
def test_different_looks(a, b):
    assert RUN(a) != RUN(b) and RUN(RUN(a)) == RUN(a)


def test_the_longest_source_wins():
    transducer = lookalike.transducer()
    assert {len(s) for s in transducer.table} >= {1, 2, 3}
    assert transducer.cluster("i\u0307\u0301") == "i\u0307\u0301" and transducer.cluster("i\u0307") == "i" and transducer.cluster("i") == "i"
    with pytest.raises(ValueError):
        transducer._add("А", "B")


def test_classes_of_one_look(spark, monkeypatch):
    """A form with most rows, many of one string: classes, links, and pairs in slices as without."""
    texts = ["Аmstel"] * 40 + ["Amstel"] * 30 + ["Ａmstel"] + ["dag", "dаg", None, "", "\u200b"] + ["solo"] * 5
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "dag", "x")], "id bigint, text string, _form string")
    whole = rows(lookalike.same_look_pairs(df, "id", "text"))
    expected = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and RUN(a) == RUN(b) != ""]
    assert whole == sorted(expected, key=repr)
    monkeypatch.setattr(spread, "HOT_LEAST", 5)
    assert rows(lookalike.same_look_pairs(df, "id", "text")) == whole
    found = {r["id"]: (r["class_id"], r["links"]) for r in lookalike.SameLook(df, "id", "text").classes().collect()}
    degree = Counter(x for p in expected for x in p)
    assert {i: n for i, (_, n) in found.items()} == degree
    assert all(c == (0 if i < 71 else 71) for i, (c, _) in found.items())
    assert lookalike.SameLook(df.limit(0), "id", "text").classes().count() == 0


def test_one_pass_over_all_blocks(spark, monkeypatch):
    """Items of three blocks: one scan, one index a shard, and the same spans as one block; removals merge spans of several items."""
    w = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(k, " ".join(w[6 * k : 6 * k + 12])) for k in range(6)], "item_id int, text string")
    docs = spark.createDataFrame([(1, " ".join(w[:45])), (2, "x " + " ".join(w[2:13]) + " y " + " ".join(w[30:42]) + "."), (3, None)], "doc_id int, text string").repartition(2)
    whole = rows(leaks.leaked_spans(items, docs))
    assert whole
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 24)
    got = leaks.leaked_spans(items, docs)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert rows(got) == whole
    monkeypatch.setattr(leaks, "PASS_BLOCKS", 2)
    twice = leaks.leaked_spans(items, docs)
    assert twice._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2 and rows(twice) == whole
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    removed = [(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["items"]) for r in leaks.removal_spans(got).orderBy("doc_id", "start").collect()]
    # the last item reaches beyond the first text, and eight of its words stand there
    assert removed == [(1, " ".join(w[:42]), 6), (2, " ".join(w[2:12]), 1), (2, " ".join(w[30:42]), 1)]
    assert leaks.removal_spans(got.limit(0)).count() == 0


def test_members_of_overlaps(spark, monkeypatch):
    texts = [("a b c d e", "train"), ("A b c, d e", "test"), ("a b c d f", "test"), ("x y", "train"), ("x y", None), ("", "test"), ("a b c d e", "test")]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "sample_index bigint, text string, split string")
    expected = [(0, 0, "train", 0), (1, 0, "test", 1), (2, 2, "test", 1), (3, 3, "train", 0), (6, 0, "test", 1)]
    assert rows(overlap.Overlaps(df).counted()) == expected
    monkeypatch.setattr(spread, "HOT_LEAST", 1)
    assert rows(overlap.Overlaps(df).counted()) == expected


def templated(count, seed=1):
    """Transcripts of ten templates of 20 words with eight slots of 50 words each; every 40th evaluation text repeats a training text but for two words."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        t = rng.randrange(10)
        words_ = [f"t{t}x{k}" for k in range(20)]
        for slot in range(8):
            words_.insert(2 * slot + 1, f"s{slot}y{rng.randrange(50)}")
        out.append((i, " ".join(words_), "test" if i % 4 == 3 else "train"))
        if i % 160 == 3:
            words_ = out[i - 1][1].split()
            words_[4] = words_[9] = "other"
            out[i] = (i, " ".join(words_), "test")
    return out


def test_candidates_of_templates(spark):
    """Twice as many templated texts give about twice as many candidates, and no link is lost."""
    seen = []
    for count in (400, 800):
        data = templated(count)
        found = overlap.Overlaps(spark.createDataFrame(data, "sample_index bigint, text string, split string"))
        seen.append(found.candidates.count())
        if count == 400:
            held = [d for d in data if d[2] == "test"]
            every = [(a, b) for a in held for b in data if b[2] == "train"]
            edits_ = distances([a[1].split() for a, _ in every], [b[1].split() for _, b in every])
            expected = {(min(a[0], b[0]), max(a[0], b[0])) for (a, b), d in zip(every, edits_, strict=True) if 5 * d <= 28}
            assert set(rows(found.pairs().select("id_a", "id_b"))) == expected
        assert found.links.count() >= count // 160
    assert seen[1] <= 3 * seen[0] + 100 and seen[1] <= 800


def test_hot_keys_are_sliced(spark, monkeypatch):
    """A key that most texts share: the grid gives the pairs that one join gives."""
    data = [(i, f"same rare words here {i % 7} and {i % 3}", "test" if i % 3 else "train") for i in range(60)]
    df = spark.createDataFrame(data, "sample_index bigint, text string, split string")
    whole = rows(overlap.Overlaps(df).pairs())
    monkeypatch.setattr(overlap, "HOT_KEY", 2)
    assert rows(overlap.Overlaps(df).pairs()) == whole and len(whole) > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=4, max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 29), st.integers(0, 300)), max_size=6))
def test_marks_change_by_two_bits_an_edit(text, changes):
    def marks(ws):
        out = 0
        for x in ws:
            out ^= 1 << (hash((x, "w")) & 63)
        return out

    other = list(text)
    for kind, at, word in changes:
        at %= len(other) + 1
        if kind == 0:
            other.insert(at, word)
        elif at < len(other):
            other[at : at + 1] = [] if kind == 1 else [word]
    assert (marks(text) ^ marks(other)).bit_count() <= 2 * int(distances([text], [other])[0])
