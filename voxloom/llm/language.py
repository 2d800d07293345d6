"""Languages of documents and of their stretches, by prediction with partial matching."""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import LANGUAGES, language_of_label

#: Longest context in bytes.
ORDER = 4
#: The labelled sample the model is fitted on: documents of each language, and characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 400, 8_000
#: Rounds in which sample documents and sentences that fit another language better than their label are left out.
CLEANINGS = 1
#: The odds of a language are 2 ** (bits / temper), as words of a sentence aren't independent; the temper where none can be fitted.
TEMPER_BITS = 8.0
#: Tempers tried, and shares of sentences that aren't in their document's language.
TEMPERS, STRAY = np.exp2(np.arange(0, 13) / 2), (0.001, 0.003, 0.01, 0.03, 0.1)
#: Words that make a piece of text a sentence of its own even without a sentence end.
LEAST_WORDS = 6
#: Lines without sentence end, all as long as the width allows, that make a text wrapped rather than a list.
WRAPPED_LINES = 5
#: Scored words that a worker remembers.
MEMORY = 400_000

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|[\r\n]+")
PIECE_END = re.compile(r"[.!?…][\"'»”’)\]]*\s*$", re.M)
DOTS = re.compile(r"(?:\.\.|…)[\"'»”’)\]]*\s*$")
LINE_END = re.compile(r"\r\n|\r|\n")
LINE = re.compile(r"[^\s](?:[^\r\n]*[^\s])?")
#: What begins a line of its own: list marks, times, headings, speakers.
MARK = re.compile(r"[-*•#>\[]|\d+[.):]|[^\W\d_a-zß-ÿ]\w*:\s")
#: A quoted phrase; it and a heading are no sentences.
PHRASE = re.compile(r"\s*[\"“”«„'‘][^.!?…]*[\"”“»'’]\s*$")
HEADING = re.compile(r"\s*#")
#: Abbreviations that stand before a word of the same sentence.
ABBREVIATIONS = frozenset("dr dra mr mrs ms sr sra srta prof st jr nr mme mlle dhr mevr drs bzw ca bijv vgl evtl pág núm".split())


class ContextTrees:
    """Per-language variable-order byte contexts with escape probabilities (method C), frozen after fitting.

    A word is coded byte by byte, blank to blank, in contexts of up to ORDER bytes that reach back to its first blank.
    In a language a byte costs -log2(count / (n + q)) in the longest context that has seen it, after -log2(q / (n + q))
    for each longer known context that hasn't (n symbols seen there, q different ones), and 8 bits beyond all. For
    every known (context, byte) the costs in all languages are computed once, escapes resolved.
    """

    def __init__(self, samples: dict[str, Counter], temper: float = TEMPER_BITS) -> None:
        self.temper = temper
        self.languages = [x for x in LANGUAGES if samples.get(x)]
        grams: list[dict[bytes, int]] = []  # a context and the byte after it
        sums: list[dict[bytes, tuple[int, int]]] = []  # of each context the symbols seen, and the different ones
        for language in self.languages:
            seen: dict[bytes, int] = {}
            for word, times in samples[language].items():
                coded = b" " + word.encode("utf-8", "replace") + b" "
                for at in range(1, len(coded)):
                    for begin in range(max(0, at - ORDER), at + 1):
                        gram = coded[begin : at + 1]
                        seen[gram] = seen.get(gram, 0) + times
            total: dict[bytes, tuple[int, int]] = {}
            for gram, times in seen.items():
                n, q = total.get(gram[:-1], (0, 0))
                total[gram[:-1]] = (n + times, q + 1)
            grams.append(seen)
            sums.append(total)
        width = len(self.languages)
        escapes: dict[bytes, list[float]] = {}
        for context in set().union(*sums):
            totals = [t.get(context, (0, 0)) for t in sums]
            escapes[context] = [math.log2((n + q) / q) if q else 0.0 for n, q in totals]
        costs: dict[bytes, list[float]] = {}
        for gram in sorted(set().union(*grams), key=len):  # shorter contexts first, so that their costs are there
            context, row, below = gram[:-1], [], None
            for j, seen in enumerate(grams):
                times = seen.get(gram)
                if times:
                    n, q = sums[j][context]
                    row.append(math.log2((n + q) / times))
                else:
                    if below is None:
                        below = self._back(costs, escapes, context, gram[-1], width)
                    row.append(escapes[context][j] + below[j])
            costs[gram] = row
        self.cost_at = {gram: i for i, gram in enumerate(costs)}
        self.escape_at = {c: i for i, c in enumerate(escapes)}
        self.costs = np.array(list(costs.values()), np.float32).reshape(-1, width)
        self.escapes = np.array(list(escapes.values()), np.float32).reshape(-1, width)

    @staticmethod
    def _back(costs: dict, escapes: dict, context: bytes, symbol: int, width: int) -> list[float]:
        """Costs of the byte in the contexts shorter than ``context``."""
        if not context:
            return [8.0] * width
        shorter = context[1:]
        row = costs.get(shorter + bytes((symbol,)))
        if row is None:
            row = [a + b for a, b in zip(escapes[shorter], ContextTrees._back(costs, escapes, shorter, symbol, width), strict=True)]
        return row

    def word_bits(self, word: str) -> np.ndarray:
        """The word's exact code length in each language."""
        coded = b" " + word.encode("utf-8", "replace") + b" "
        cost_at, escape_at = self.cost_at, self.escape_at
        rows, escaped, flat = [], [], 0
        for at in range(1, len(coded)):
            begin = max(0, at - ORDER)
            while True:
                row = cost_at.get(coded[begin : at + 1])
                if row is not None:
                    rows.append(row)
                    break
                gone = escape_at.get(coded[begin:at])
                if gone is not None:
                    escaped.append(gone)
                if begin == at:
                    flat += 1
                    break
                begin += 1
        total = self.costs[rows].sum(axis=0) if rows else np.zeros(len(self.languages), np.float32)
        if escaped:
            total = total + self.escapes[escaped].sum(axis=0)
        return total + np.float32(8.0 * flat)


def joined_lines(text: str) -> tuple[set[int], int]:
    """(Ends of the lines that go on in the next one, words that make a line without sentence end a unit; 0 for none).

    In a text with sentence ends a line without one goes on in the next line of its paragraph if that begins in lower
    case (in a text with capitals) or its first word wouldn't have fitted in the paragraph's width. In a text whose lines
    mostly have no sentence end each line is a sentence; where such lines look wrapped, LEAST_WORDS words of them are a unit.
    """
    inner: set[int] = set()
    lines = open_lines = full = followed = lower = 0
    cased = text.lower() != text
    ended = PIECE_END.search(text) is not None
    spans = [m.span() for m in LINE.finditer(text)]
    first = 0
    while first < len(spans):
        last = first + 1
        while last < len(spans) and len(LINE_END.findall(text, spans[last - 1][1], spans[last][0])) < 2:
            last += 1
        width = max(b - a for a, b in spans[first:last])
        for k in range(first, last):
            a, b = spans[k]
            line = text[a:b]
            if line.startswith("#") or not LETTERS.search(line):
                continue
            lines += 1
            if PIECE_END.search(line):
                continue
            open_lines += 1
            lower += line[0].islower()
            if k + 1 == last or MARK.match(text, spans[k + 1][0]):
                continue
            following = text[slice(*spans[k + 1])]
            wrapped = b - a + 1 + len(following.split(None, 1)[0]) > width
            full += wrapped
            followed += 1
            if ended and (wrapped or (cased and following[0].islower())):
                inner.add(b)
        first = last
    if 2 * (open_lines - len(inner)) <= lines - len(inner):
        return inner, 0
    wrapped = full == followed >= WRAPPED_LINES and (lower > 0 if cased else True)
    return inner, LEAST_WORDS if wrapped else 1


def line_end(text: str, at: int) -> int:
    """Where the line ends without its last blanks."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def whole_sentence(piece: str, words: list[str]) -> bool:
    """Whether a piece of few words ends as a sentence does: not at an abbreviation, an initial or dots within a sentence."""
    if not PIECE_END.search(piece) or DOTS.search(piece):
        return False
    return not (piece.rstrip().endswith(".") and (len(words[-1]) == 1 or words[-1] in ABBREVIATIONS))


def units_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences; wrapped lines are joined, and quoted phrases and fragments join a neighbour.

    A piece of LEAST_WORDS words or more is a sentence also without a sentence end; of fewer words only with one, or as
    a line of a text whose lines have none. The words of a quoted phrase tell nothing of the stretch around it: they are
    left out unless there are no others.
    """
    out: list[tuple[int, int, list[str]]] = []
    begin = 0
    held: list[str] = []
    phrases: list[str] = []
    held_at = -1
    dots = False
    inner, least = joined_lines(text) if LINE_END.search(text) else (set(), 0)
    ends = [(m.start(), m.end()) for m in SENTENCE_END.finditer(text) if not inner or line_end(text, m.start()) not in inner]
    ends.append((len(text), len(text)))
    for end, after in ends:
        piece = text[begin:end]
        found = LETTERS.findall(piece.lower())
        if found:
            line = least and len(held) + len(found) >= least and (after == len(text) or LINE_END.search(text, end, after))
            if dots and held_at < 0 and len(found) < LEAST_WORDS:  # the rest of the sentence before
                first, _, had = out[-1]
                out[-1] = (first, end, had + found)
            elif len(found) >= LEAST_WORDS or whole_sentence(piece, found) or (line and not PHRASE.match(piece) and not HEADING.match(piece)):
                out.append((held_at if held_at >= 0 else begin, end, held + found))
                held, held_at = [], -1
            else:
                if held_at < 0:
                    held_at = begin
                if PHRASE.match(piece):
                    phrases += found
                else:
                    held += found
            dots = DOTS.search(piece) is not None
        begin = after
    if held_at >= 0:
        if out:
            first, _, had = out[-1]
            out[-1] = (first, len(text), had + held)
        else:
            out.append((held_at, len(text), held or phrases))
    return out


def change_bits(units: int, languages: int) -> float:
    """Bits that a change of language costs: those that tell its place in the document and the new language."""
    return math.log2(max(units - 1, 1)) + math.log2(max(languages - 1, 1))


def stretches(bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(first unit, last unit + 1, language) of the cheapest division into stretches of two units at least.

    A document of one unit is one stretch. Only where some run of two or more units gains
    more bits in another language than a change costs is the division searched.
    """
    count, width = bits.shape
    whole = int(bits.sum(axis=0).argmin())
    if count < 4 or width < 2:  # two stretches need four units
        return [(0, count, whole)]
    cost = change_bits(count, width)
    gain = bits[:, whole : whole + 1] - bits
    total = np.concatenate((np.zeros((1, width)), np.cumsum(gain, axis=0)))
    if (total[2:] - np.minimum.accumulate(total[:-2], axis=0)).max() <= cost:
        return [(0, count, whole)]
    # new[t][l]: units up to t, the last stretch having one unit so far; old: two or more
    new, old = np.full((count, width), np.inf), np.full((count, width), np.inf)
    new_from, old_from = np.zeros((count, width), np.int64), np.zeros((count, width), bool)
    new[0] = bits[0]
    for t in range(1, count):
        best = int(old[t - 1].argmin())
        new[t] = old[t - 1][best] + cost + bits[t]
        new_from[t] = best
        longer = old[t - 1] < new[t - 1]
        old[t] = np.where(longer, old[t - 1], new[t - 1]) + bits[t]
        old_from[t] = longer
    out, end, t = [], count, count - 1
    language, is_old = int(old[t].argmin()), True
    while True:
        if is_old:
            is_old = bool(old_from[t, language])
            t -= 1
        else:
            out.append((t, end, language))
            if t == 0:
                break
            language, end, is_old = int(new_from[t, language]), t, True
            t -= 1
    merged: list[tuple[int, int, int]] = []
    for first, last, lang in reversed(out):
        if merged and merged[-1][2] == lang:
            merged[-1] = (merged[-1][0], last, lang)
        else:
            merged.append((first, last, lang))
    return merged


def confidence(bits: np.ndarray, chosen: int, temper: float = TEMPER_BITS) -> float:
    """The share of the chosen language among all, by tempered code lengths."""
    return float(1.0 / np.exp2(-(bits - bits[chosen]) / temper).sum())


def fitted_temper(bits: np.ndarray, own: np.ndarray) -> float:
    """The temper under which held-out sentences (sentences x languages) most likely have their documents' languages.

    Together with it the share of stray sentences is chosen, so that a few of those don't flatten all odds.
    """
    best = (-math.inf, TEMPER_BITS)
    for temper in TEMPERS:
        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / temper)
        share = odds[np.arange(len(own)), own] / odds.sum(axis=1)
        for stray in STRAY:
            best = max(best, (float(np.log((1 - stray) * share + stray / bits.shape[1]).sum()), float(temper)))
    return best[1]


class Scorer:
    """Code lengths of sentences, remembering words."""

    def __init__(self, trees: ContextTrees) -> None:
        self.trees = trees
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.trees.languages)), np.float32)

    def bits(self, words: list[str]) -> np.ndarray:
        if len(self.at) > MEMORY:
            self.clear()
        at = self.at
        for word in set(words).difference(at):
            if len(at) == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[len(at)] = self.trees.word_bits(word)
            at[word] = len(at)
        return self.table[list(map(at.__getitem__, words))]

    def units(self, documents: list[list[tuple[int, int, list[str]]]]) -> Iterator[np.ndarray]:
        """For each document the bits of its units (units x languages)."""
        for k in range(0, len(documents), 256):
            part = documents[k : k + 256]
            words = [w for units in part for _, _, ws in units for w in ws]
            sizes = np.array([len(ws) for units in part for _, _, ws in units], np.int64)
            if not len(sizes):
                yield from (np.zeros((0, len(self.trees.languages)), np.float32) for _ in part)
                continue
            sums = np.add.reduceat(self.bits(words), np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.float64)
            at = 0
            for units in part:
                yield sums[at : at + len(units)]
                at += len(units)


def plain(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def trees_of(sentences: list[tuple[str, list[str]]]) -> ContextTrees | None:
    """Trees from (language, words), words also without their accents; None without any word."""
    counts: dict[str, Counter] = {}
    for lang, ws in sentences:
        counts.setdefault(lang, Counter()).update(ws)
    if not counts:
        return None
    for words in counts.values():
        for word, times in list(words.items()):
            if (bare := plain(word)) != word:
                words[bare] += times
    return ContextTrees(counts)


def fit(rows: list[tuple[str, str]]) -> ContextTrees | None:
    """Trees from (language, text).

    Documents, and sentences, nearer to another language than their label are left out in turns. The temper of the
    confidence comes from trees of every second document and the sentences of those others that are in one language.
    """
    documents = [(lang, [ws for _, _, ws in units_of(text)]) for lang, text in rows]
    kept = [(lang, ws, k) for k, (lang, sentences) in enumerate(documents) for ws in sentences]
    for _ in range(CLEANINGS):
        trees = trees_of([x[:2] for x in kept])
        if trees is None:
            return None
        scorer, kept = Scorer(trees), []
        for k, (lang, sentences) in enumerate(documents):
            if lang not in trees.languages or not sentences:
                continue
            own = trees.languages.index(lang)
            bits = [scorer.bits(ws).sum(axis=0) for ws in sentences]
            if int(np.sum(bits, axis=0).argmin()) == own:
                kept += [(lang, ws, k) for ws, x in zip(sentences, bits, strict=True) if int(x.argmin()) == own]
    model = trees_of([x[:2] for x in kept])
    half = trees_of([x[:2] for x in kept if x[2] % 2 == 0])
    if half is not None and len(half.languages) > 1:
        scorer, bits, own = Scorer(half), [], []
        for lang, sentences in documents[1::2]:
            if lang not in half.languages or not sentences:
                continue
            here = np.array([scorer.bits(ws).sum(axis=0) for ws in sentences], np.float64)
            if [x[2] for x in stretches(here)] == [half.languages.index(lang)]:  # as one of its label only
                bits.append(here)
                own += [half.languages.index(lang)] * len(here)
        if bits:
            model.temper = fitted_temper(np.concatenate(bits), np.array(own))
    return model


def excerpt(text: str) -> str:
    """The text's whole sentences in its first SAMPLE_CHARS characters; whole words if the first sentence is longer."""
    if len(text) <= SAMPLE_CHARS:
        return text
    text = text[: SAMPLE_CHARS + 1]
    units = units_of(text)
    if len(units) > 1:
        return text[: units[-2][1]]
    whole = re.match(r"[\s\S]*\s", text)
    return whole[0] if whole else text[:SAMPLE_CHARS]


def fitted(documents: DataFrame, text: str, label: str, id_col: str) -> ContextTrees | None:
    """Trees fitted on at most SAMPLE_DOCUMENTS labelled documents a language, the first in the order of a hash.

    Of texts longer than SAMPLE_CHARS an excerpt from their first letter on is sampled; the sample, and with it what
    reaches the driver, is bounded. A warning names the languages without a sample, which can't be found.
    """
    whole = F.col(text)
    # a character more than SAMPLE_CHARS tells that there is more
    start = F.when(F.length(whole) <= SAMPLE_CHARS, whole).otherwise(F.regexp_extract(whole, rf"(?s)\p{{L}}.{{0,{SAMPLE_CHARS}}}", 0))
    rows = documents.select(
        F.col(id_col).alias("_doc"), start.alias("_text"), language_of_label(F.col(label)).alias("_lang")
    ).where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    ranked = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64(F.lit(42), "_doc"), "_doc"))
    ).where(F.col("_rank") <= SAMPLE_DOCUMENTS)
    model = fit([(r["_lang"], excerpt(r["_text"])) for r in ranked.select("_lang", "_text", "_doc").orderBy("_lang", "_doc").collect()])
    missing = [x for x in LANGUAGES if model is None or x not in model.languages]
    if missing:
        warnings.warn(f"no labelled sample of {', '.join(missing)}: no text is found to be in these languages", stacklevel=2)
    return model


def language_stretches(
    documents: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", trees: ContextTrees | None = None
) -> DataFrame:
    """A row for each stretch: (doc, label_lang, seg_no, segs, lang, confidence, start, end).

    ``label_lang`` is the language that the label names, in any usual spelling, or null.
    ``start`` and ``end`` are character offsets of the stretch in the text. Null
    texts and texts without a letter have no row. Without any labelled document
    to fit, and no ``trees``, there is no row at all. Whole texts are scored.
    """
    model = trees or fitted(documents, text, label, id_col)
    rows = documents.select(
        F.col(id_col).alias(id_col), F.col(text).alias("_text"), language_of_label(F.col(label)).alias("label_lang")
    )
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, label_lang string, seg_no int, segs int, lang string, confidence double, start int, end int"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = shared.value.languages
        for batch in batches:
            for piece in range(0, batch.num_rows, 1024):
                part = batch.slice(piece, 1024)
                units = [units_of(t) if t else [] for t in part.column(1).to_pylist()]
                at: list[int] = []
                cols: list[list] = [[] for _ in range(6)]
                for row, (mine, bits) in enumerate(zip(units, scorer.units(units), strict=True)):
                    if not mine:
                        continue
                    found = stretches(bits)
                    for k, (first, last, lang) in enumerate(found):
                        at.append(row)
                        sure = confidence(bits[first:last].sum(axis=0), lang, shared.value.temper)
                        for c, x in zip(cols, (k, len(found), names[lang], sure, mine[first][0], mine[last - 1][1]), strict=True):
                            c.append(x)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(2).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=[id_col, "label_lang", "seg_no", "segs", "lang", "confidence", "start", "end"],
                )

    return rows.mapInArrow(score, schema)


def mislabelled(found: DataFrame) -> DataFrame:
    """The stretches of documents whose label names no language or not theirs, or that are in several languages."""
    return found.where((F.col("segs") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")))
