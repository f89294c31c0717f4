"""Problem 8: missing or wrong document language labels.

Sentences are told by a hierarchy of linear support vector machines. The first step tells the language family, the second
the language within it. Both are one-versus-one: a step with k choices has k (k - 1) / 2 machines, each fitted only to the
sentences of its two choices, and the choice that wins most machines is taken (of equals the one with most margin). The
confidence couples the machines' margins into a probability of each choice, and multiplies those of the two steps.

Features of a sentence are the mean of its words' features (the word, and its runs of two to four letters), hashed. A
linear score is then the mean of scores of words, which are kept per word, so a batch of sentences costs a lookup per word
and one sum per sentence.

Headings, fenced and indented code, score lines, identifiers, paths, numbers and inline code are no text of a language.
A sentence ends with a mark of Unicode's property Sentence_Terminal or an ellipsis and has at least LEAST_WORDS words; in
scripts without blanks between words every two neighbouring letters count as one, a mark needs no blank after it, and Thai
and Lao, which have no marks, are read by the line.

The model is fitted at the driver on a bounded sample of labelled documents: at most TRAIN_DOCS of each language, and of
their sentences at most TRAIN_SENTENCES, each time those of least hash. Labels may be wrong, so it is fitted twice, the second time without sentences that the first fit contradicts.
Only languages seen in the sample get machines. A language that FAMILIES doesn't list joins the others of its script.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspan.sources.tables import spread, table

TRAIN_DOCS, TRAIN_SENTENCES = 200, 4000
DIMENSIONS = 1 << 16
EPOCHS = 4
LEAST_WORDS = 3
SEED = 8
#: Bounds of what is sent to every executor: rows of the table of languages, and bytes of the machines' weights.
MOST_CODES, MOST_BYTES = 4096, 256 << 20
#: Words and tokens whose scores and parts a worker remembers.
REMEMBERED = 200_000
#: Language families, by code.
FAMILIES = {"germanic": ("en", "de", "nl", "sv"), "romance": ("fr", "es", "pt", "it"), "slavic": ("pl", "ru")}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

_CLOSING = r"\"'»”)\]\p{Pe}\p{Pf}\p{Cf}"
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
_FENCE = regex.compile(r"^[\s\p{Cf}]*(```|~~~)")
_SKIPPED = regex.compile(r"^[\s\p{Cf}]*(?:#{1,6}(?:\s|$)|\d+(?:\.\d+)?\s+\S+:\d+)")
_MARKER = regex.compile(r"^[\s\p{Cf}>]*(?:[-*+]\s+|\d+[.)]\s+)?")
_ENDS = regex.compile(rf"[\p{{Sentence_Terminal}}…][{_CLOSING}]*\s+|[。！？｡][{_CLOSING}]*(?=[^\s{_CLOSING}\p{{Sentence_Terminal}}…])")
_COMPLETE = regex.compile(rf"[\p{{Sentence_Terminal}}…][{_CLOSING}\s\p{{So}}\p{{Sk}}\p{{M}}]*$|[\p{{Thai}}\p{{Lao}}]")
_INLINE = regex.compile(r"`[^`]*`")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*")
_PAIRS = regex.compile(rf"[{_UNSPACED}]\p{{M}}*[{_UNSPACED}]")
_FORMAT = regex.compile(r"\p{Cf}+")
_NAME = regex.compile(r"[\d_/:#\\{}=<>]|\p{L}\.\p{L}|\p{Ll}\p{Lu}")
_SCRIPTS = {x: regex.compile(rf"\p{{{x}}}") for x in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hangul", "Thai")}

_parts: dict[str, tuple[str, ...]] = {}


def _words_of(token: str) -> tuple[str, ...]:
    """The words of a text without blanks; remembered, as texts use the same words again and again."""
    bare = token.strip(".,;:!?…()[]\"“”«»*")
    out: list[str] = []
    if bare and not _NAME.search(bare):
        for word in _WORD.findall(bare):
            word = word.lower().replace("’", "'")
            out += [word] if word.isascii() else _PAIRS.findall(word, overlapped=True) or [word]
    if len(_parts) >= REMEMBERED:
        _parts.clear()
    if len(token) <= 64:
        _parts[token] = tuple(out)
    return tuple(out)


def words(sentence: str) -> list[str]:
    """The lower-case words of a sentence, without identifiers, paths, numbers and code."""
    if "`" in sentence:
        sentence = _INLINE.sub(" ", sentence)
    if not sentence.isascii():
        sentence = _FORMAT.sub("", sentence)
    out: list[str] = []
    for token in sentence.split():
        known = _parts.get(token)
        out += _words_of(token) if known is None else known
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the full sentences of a text, in code points."""
    out: list[tuple[int, int, list[str]]] = []
    fenced, at = False, 0
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or line.isspace() or _SKIPPED.match(line):
            continue
        begin = _MARKER.match(line).end()
        body = line[begin:]
        cut = 0
        for end in [*(m.end() for m in _ENDS.finditer(body)), len(body)]:
            piece = body[cut:end]
            if piece.strip() and _COMPLETE.search(piece):
                own = words(piece)
                if len(own) >= LEAST_WORDS:
                    out.append((start + begin + cut, start + begin + cut + len(piece.rstrip()), own))
            cut = end
    return out


def features(word: str, dimensions: int = DIMENSIONS) -> list[int]:
    """Hashed features of a word."""
    padded = f"^{word}$"
    grams = [padded, *(padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1))]
    return [crc32(g.encode()) % dimensions for g in grams]


def coupled(margins: np.ndarray, pairs: np.ndarray, choices: int) -> tuple[np.ndarray, np.ndarray]:
    """The choice of each row and its probability, from the margins (columns) of the machines between pairs of choices.

    Most machines won decides, of equals the greater sum of margins, of these the lower number. The probability is that of
    pairwise coupling, 1 / (sum of 1 / r - (k - 2)) over the machines of the choice, scaled to a sum of one.
    """
    rows = len(margins)
    if choices == 1:
        return np.zeros(rows, dtype=np.int64), np.ones(rows)
    votes, gained, inverse = np.zeros((rows, choices)), np.zeros((rows, choices)), np.full((rows, choices), 2.0 - choices)
    for k, (i, j) in enumerate(pairs):
        m = margins[:, k]
        won = m > 0
        votes[:, i] += won
        votes[:, j] += ~won
        gained[:, i] += m
        gained[:, j] -= m
        sure = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        inverse[:, i] += 1 / sure
        inverse[:, j] += 1 / (1 - sure)
    most = np.where(votes == votes.max(axis=1, keepdims=True), gained, -np.inf)
    best = np.argmax(most, axis=1)
    share = 1 / inverse
    return best, share[np.arange(rows), best] / share.sum(axis=1)


@dataclass
class Step:
    """One choice: its machines are columns of the weights from ``first`` on, one for each pair of choices."""

    choices: list[int]
    first: int

    @property
    def pairs(self) -> np.ndarray:
        return np.array(list(combinations(range(len(self.choices)), 2)), dtype=np.int64).reshape(-1, 2)

    @property
    def columns(self) -> slice:
        return slice(self.first, self.first + len(self.choices) * (len(self.choices) - 1) // 2)


@dataclass
class Model:
    """Weights of the machines, a column each: those between families first, then those within each family."""

    families: list[str]
    languages: list[str]
    family_of: list[int]
    weights: np.ndarray
    bias: np.ndarray
    dimensions: int = DIMENSIONS
    known: dict[str, int] = field(default_factory=dict)
    scores: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def blank(cls, languages: list[str], scripts: dict[str, str] | None = None, dimensions: int = DIMENSIONS) -> Model:
        """A model of the languages with every weight zero; scripts tell the families of those that FAMILIES doesn't list."""
        family = [_FAMILY_OF.get(x) or "script " + (scripts or {}).get(x, "?") for x in languages]
        names = sorted(set(family))
        model = cls(names, languages, [names.index(x) for x in family], np.zeros((0, 0), dtype=np.float32), np.zeros(0), dimensions)
        machines = sum(len(step.pairs) for step in model.steps())
        if machines * dimensions * 4 > MOST_BYTES:
            raise ValueError(f"{machines} machines of {dimensions} weights take more than {MOST_BYTES} bytes: split FAMILIES further")
        model.weights, model.bias = np.zeros((dimensions, machines), dtype=np.float32), np.zeros(machines)
        return model

    def steps(self) -> list[Step]:
        """The choice between families, then the choice within each."""
        out = [Step(list(range(len(self.families))), 0)]
        for f in range(len(self.families)):
            out.append(Step([k for k, g in enumerate(self.family_of) if g == f], out[-1].columns.stop))
        return out

    def place(self, word: str) -> int:
        """Where the word's scores are."""
        found = self.known.get(word)
        if found is None:
            own = features(word, self.dimensions)
            found = self.known[word] = len(self.scores)
            self.scores.append((self.weights[own].sum(axis=0) / math.sqrt(len(own))).astype(np.float64))
        return found

    def tell_all(self, own: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The language (its number) of each sentence, given by its words, and a confidence from 0 to 1."""
        if len(self.known) >= REMEMBERED:
            self.known, self.scores = {}, []
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        known, places = self.known, []
        for sentence in own:
            for word in sentence:
                found = known.get(word)
                places.append(self.place(word) if found is None else found)
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        scores, places = np.array(self.scores), np.array(places)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        margins = np.stack([np.add.reduceat(scores[places, k], starts) for k in range(scores.shape[1])], axis=1) if scores.shape[1] else np.zeros((len(own), 0))
        margins = margins / sizes[:, None] + self.bias
        first, *inner = self.steps()
        family, sure = coupled(margins[:, first.columns], first.pairs, len(first.choices))
        out = np.zeros(len(own), dtype=np.int64)
        for f, step in enumerate(inner):
            some = np.flatnonzero(family == f)
            best, share = coupled(margins[some, step.columns], step.pairs, len(step.choices))
            out[some] = np.array(step.choices)[best]
            sure[some] *= share
        return out, sure

    def tell(self, own: list[str]) -> tuple[str, float]:
        """The language of a sentence's words, and a confidence from 0 to 1."""
        best, sure = self.tell_all([own])
        return self.languages[best[0]], float(sure[0])


def fitted(samples: list[tuple[str, list[str]]], dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Machines fitted to (language, words) by averaged stochastic subgradient descent on the hinge loss. A sentence counts
    for the machines between its family and the others, and for those between its language and the others of its family."""
    languages = sorted({x for x, _ in samples})
    letters: dict[str, Counter[str]] = {x: Counter() for x in languages if x not in _FAMILY_OF}
    for language, own in samples:
        if language in letters:
            letters[language].update(next((s for s, known in _SCRIPTS.items() if known.match(w)), "other") for w in own)
    model = Model.blank(languages, {x: min(c, key=lambda s: (-c[s], s)) for x, c in letters.items() if c}, dimensions)
    first, *inner = model.steps()
    played: list[tuple[np.ndarray, np.ndarray]] = []  # of each language: the machines it counts for, and its side in them
    for k, f in enumerate(model.family_of):
        sides = [(first.first + c, 1.0 if i == f else -1.0) for c, (i, j) in enumerate(first.pairs) if f in (i, j)]
        at = inner[f].choices.index(k)
        sides += [(inner[f].first + c, 1.0 if i == at else -1.0) for c, (i, j) in enumerate(inner[f].pairs) if at in (i, j)]
        played.append((np.array([x for x, _ in sides], dtype=np.int64), np.array([x for _, x in sides], dtype=np.float32)))
    index: dict[str, tuple[np.ndarray, float]] = {}
    rows = []
    for language, own in samples:
        which, values = [], []
        for word in own:
            if word not in index:
                hashed = features(word, dimensions)
                index[word] = np.array(hashed), 1 / math.sqrt(len(hashed))
            which.append(index[word][0])
            values.append(np.full(len(index[word][0]), index[word][1] / len(own), dtype=np.float32))
        rows.append((languages.index(language), np.concatenate(which), np.concatenate(values)))
    rng = np.random.default_rng(seed)
    weights, bias, summed, summed_bias, steps = model.weights, model.bias, np.zeros_like(model.weights), np.zeros_like(model.bias), 0
    for epoch in range(epochs):
        rate = 2.0 / (1 + epoch)
        for k in rng.permutation(len(rows)):
            language, which, values = rows[k]
            machines, target = played[language]
            margin = target * (values @ weights[which[:, None], machines] + bias[machines])
            wrong = np.flatnonzero(margin < 1)
            if len(wrong):
                step = rate * target[wrong]
                np.add.at(weights, (which[:, None], machines[wrong][None, :]), values[:, None] * step[None, :])
                bias[machines[wrong]] += 0.05 * step
        if epoch:
            summed += weights
            summed_bias += bias
            steps += 1
    if steps:
        model.weights, model.bias = summed / steps, summed_bias / steps
    return model


def fitted_twice(samples: list[tuple[str, list[str]]]) -> Model:
    """A fit, and another without the samples whose label the first contradicts."""
    first = fitted(samples)
    told, _ = first.tell_all([own for _, own in samples])
    return fitted([x for x, k in zip(samples, told, strict=True) if first.languages[k] == x[0]])


def label_code(label: Column, codes: dict[str, str]) -> Column:
    """The code that a label names, by code, three-letter code or English name; null where it names none."""
    head = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"[\s\x{00A0}\x{200B}\x{FEFF}]", " "))), r"^([^-_ ]+)(?:[-_ ].*)?$", 1)
    pairs = F.create_map(*(F.lit(x) for pair in sorted(codes.items()) for x in pair))
    return F.try_element_at(pairs, head)


def known_codes(language_codes: DataFrame) -> dict[str, str]:
    """Code, three-letter code and English name of each language, lower case, to its code; at most MOST_CODES languages."""
    rows = language_codes.where("code is not null").limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"the table of languages has more than {MOST_CODES} rows")
    return {str(x).strip().lower(): r["code"] for r in rows for x in (r["english_name"], r["code3"], r["code"]) if x}


def training_model(documents: DataFrame, codes: dict[str, str], docs: int = TRAIN_DOCS) -> Model | None:
    """The model fitted on at most ``docs`` labelled documents a language; None without any labelled sentence."""
    w = Window.partitionBy("_code").orderBy("_h", "doc_id")
    labelled = documents.select("doc_id", "text", label_code(F.col("lang"), codes).alias("_code")).where("_code is not null and trim(text) <> ''")
    chosen = labelled.withColumn("_h", F.xxhash64("doc_id")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= docs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(c, " ".join(own)) for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, own in sentences(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["code", "words"])

    counts = chosen.select("_code", "text").mapInArrow(split, "code string, words string").groupBy("words", "code").agg(F.count("*").alias("n"))
    told = counts.groupBy("words").agg(F.max_by("code", F.struct("n", "code")).alias("code"))  # of equal sentences the label most have
    least = Window.partitionBy("code").orderBy(F.xxhash64("words"), "words")
    rows = told.withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= TRAIN_SENTENCES).collect()
    samples = sorted((r["code"], r["words"].split(" ")) for r in rows)
    return fitted_twice(samples) if samples else None


def language_segments(documents: DataFrame, language_codes: DataFrame, docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, code, segments): the label's code, and the stretches of one language in each document's text.

    A segment is (lang, start, end, sentences, confidence): neighbouring full sentences of one language, from its first to
    its last code point. Null and empty texts, and those without a full sentence, have none. One row for each row.
    """
    codes = known_codes(language_codes)
    model = training_model(documents, codes, docs)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    struct = "lang string, start int, end int, sentences int, confidence double"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        item = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32()), ("confidence", pa.float64())])
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 512):
                batch = whole.slice(at, 512)
                parts = [sentences(text) if text and own else [] for text in batch.column(2).to_pylist()]
                flat = [x for each in parts for x in each]
                doc = np.repeat(np.arange(len(parts)), [len(each) for each in parts])
                langs, sure = own.tell_all([x[2] for x in flat]) if flat else (np.zeros(0, np.int64), np.zeros(0))
                # a segment begins where the document or the language changes
                begins = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (langs[1:] != langs[:-1])]) if flat else np.zeros(0, np.int64)
                ends = np.r_[begins[1:], len(flat)][: len(begins)]
                start, end = np.array([x[0] for x in flat], dtype=np.int32), np.array([x[1] for x in flat], dtype=np.int32)
                n = (ends - begins).astype(np.int32)
                names = np.array(own.languages if own else [], dtype=object)
                fields = [pa.array(names[langs[begins]], pa.string()), pa.array(start[begins]), pa.array(end[ends - 1]), pa.array(n), pa.array(np.add.reduceat(sure, begins) / n if flat else sure)]
                offsets = np.r_[0, np.cumsum(np.bincount(doc[begins], minlength=len(parts)))].astype(np.int32)
                segments = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(item)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), segments], names=["doc_id", "code", "segments"])

    rows = spread(documents.select("doc_id", label_code(F.col("lang"), codes).alias("code"), "text"))
    return rows.mapInArrow(tell, f"doc_id {kind}, code string, segments array<struct<{struct.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>")


def _segments(spark, sf_dir: str) -> DataFrame:
    return language_segments(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "language_codes"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    """The languages of each document whose label is missing or isn't its only language."""
    told = _segments(spark, sf_dir).select("doc_id", "code", F.array_distinct("segments.lang").alias("langs"))
    wrong = F.col("code").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("code"))
    return told.where((F.size("langs") > 0) & wrong).select("doc_id", F.explode("langs").alias("lang"))


def p8_documents(spark, sf_dir: str) -> DataFrame:
    """Every document's language (of most sentences; of equals the first in the text), confidence and label's code."""
    each = _segments(spark, sf_dir).select("doc_id", "code", F.explode_outer("segments").alias("s"), F.monotonically_increasing_id().alias("_row"))
    by = each.groupBy("_row", "doc_id", "code", F.col("s.lang").alias("lang")).agg(F.sum("s.sentences").alias("n"), F.min("s.start").alias("first"), (F.sum(F.col("s.sentences") * F.col("s.confidence")) / F.sum("s.sentences")).alias("sure"))
    best = by.groupBy("_row", "doc_id", "code").agg(F.max_by(F.struct("lang", "n", "sure"), F.struct("n", -F.col("first"))).alias("b"), F.sum("n").alias("total"))
    return best.select("doc_id", F.col("code").alias("label"), F.col("b.lang").alias("lang"), F.round(F.col("b.sure") * F.col("b.n") / F.col("total"), 4).alias("confidence"))


def p8_segments(spark, sf_dir: str) -> DataFrame:
    """Every stretch of one language in every document."""
    return _segments(spark, sf_dir).select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.lang", "s.start", "s.end", "s.sentences", F.round("s.confidence", 4).alias("confidence"))
