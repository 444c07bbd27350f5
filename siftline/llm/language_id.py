"""Language identification by cross-parsing entropy.

Per language a suffix automaton of a bounded sample of labelled text gives
longest-match lengths: a text is cut greedily into the longest phrases that
occur in the sample. A phrase costs the logarithm of the sample's length, so
samples of unequal length compare; the language of the least cost wins.
Automata become dense transition tables, and texts are parsed in lockstep,
thousands of pieces at once, in numpy. The sample only bounds the automata;
every text is parsed whole. Only samples travel: each Python worker builds the
tables once. More languages than PASS_LANGUAGES are parsed in several passes.
"""

from __future__ import annotations

import pickle
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textscan import release

#: Bounds of the sample: normalised characters and documents a language.
SAMPLE_CHARS = 24_000
SAMPLE_DOCS = 60
#: Characters of one document that the sample may take, so that it spans many documents.
SAMPLE_PART = 1_000
#: Languages whose counts may travel to every executor.
SHIPPED_LANGUAGES = 10_000
#: Languages whose tables are held at once.
PASS_LANGUAGES = 8
#: Letters with a symbol of their own, by frequency; rarer ones share SHARED symbols, so tables stay narrow for any script.
OWN_SYMBOLS = 128
SHARED = 64
PIECE = 1024
SLICE_CHARS = 1 << 19
_SPACE = 1


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letters(code: np.ndarray) -> np.ndarray:
    """Code points as they count: letters themselves, all else 0."""
    return np.where(_is_letter()[code], code, 0)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row) of lower-cased letters; every run of other characters between them is one 0."""
    joined = "\n".join(t.lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lengths + 1)[: len(code)]
    code = _letters(code)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    inside = np.ones(len(code), bool)
    if len(code):
        turn = row[1:] != row[:-1]
        inside = (code != 0) | ~(np.concatenate(([True], turn)) | np.concatenate((turn, [True])))
    return code[inside], row[inside]


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Dense transitions (states x alphabet) of all substrings of ``symbols``; -1 where there is none."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nexts), alphabet), -1, np.int32)
    for state, row in enumerate(nexts):
        for c, to in row.items():
            table[state, c] = to
    return table


class Model:
    """Sampled code points by language. Tables are built when first asked for and do not travel."""

    def __init__(self, samples: dict[str, list[str]]):
        self.codes = {lang: normalise(["\n".join(samples[lang])])[0][:SAMPLE_CHARS].astype(np.uint32) for lang in sorted(samples)}
        every = np.concatenate([*self.codes.values(), np.zeros(0, np.uint32)])
        values, counts = np.unique(every[every > 0], return_counts=True)
        self.known = np.sort(values[np.argsort(-counts, kind="stable")[:OWN_SYMBOLS]])
        #: Without rarer letters in the sample, all unknown ones match nothing and need one symbol.
        self.shared = SHARED if len(values) > OWN_SYMBOLS else 1
        #: Symbol 0 is unused, 1 a gap, then the known letters, then the shared ones.
        self.alphabet = len(self.known) + 2 + self.shared
        self._tables: list[np.ndarray] | None = None

    @property
    def languages(self) -> list[str]:
        return list(self.codes)

    def passes(self) -> list[Model]:
        """Models of PASS_LANGUAGES languages each that parse like this one."""
        out = []
        for k in range(0, len(self.codes), PASS_LANGUAGES):
            part = Model({})
            part.codes = {lang: self.codes[lang] for lang in self.languages[k : k + PASS_LANGUAGES]}
            part.known, part.shared, part.alphabet = self.known, self.shared, self.alphabet
            out.append(part)
        return out or [self]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    @property
    def tables(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables = []
            for code in self.codes.values():
                table = suffix_automaton(self.symbols(code).tolist(), self.alphabet)
                # a failing symbol starts the next phrase: bake the restart into the table, marked by its sign
                restart = np.maximum(table[0], 0)
                self._tables.append(np.where(table >= 0, table, ~restart).astype(np.int32).ravel())
        return self._tables

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (rows x languages), each at the logarithm of the sample's length, and letters of each text."""
        phrases, letters = self.phrases(texts)
        return phrases * np.log2([len(c) + 2.0 for c in self.codes.values()]), letters

    def symbols(self, code: np.ndarray) -> np.ndarray:
        shared = len(self.known) + 2 + (code * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(self.shared)
        if not len(self.known):
            return np.where(code == 0, _SPACE, shared).astype(np.int32)
        spot = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        return np.where(code == 0, _SPACE, np.where(self.known[spot] == code, spot + 2, shared)).astype(np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (rows x languages) and letters of each text."""
        code, row = normalise(texts)
        n = len(texts)
        letters = np.bincount(row[code > 0], minlength=n)
        symbol = self.symbols(code)
        lengths = np.bincount(row, minlength=n)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * PIECE
        size = np.minimum(PIECE, lengths[owner] - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        out = np.zeros((n, len(self.languages)))
        if not len(size):
            return out, letters
        alive = np.searchsorted(-size, -np.arange(size[0]), "left")
        for k, table in enumerate(self.tables):
            state = np.zeros(len(size), np.int32)
            cuts = np.zeros(len(size), np.int32)
            for step in range(size[0]):
                m = alive[step]
                to = table[state[:m] * self.alphabet + symbol[begin[:m] + step]]
                failed = to < 0
                cuts[:m] += failed
                state[:m] = np.where(failed, ~to, to)
            out[:, k] = np.bincount(owner, cuts + 1.0, n)
        return out, letters


def best_two(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first language of least cost, its cost, next cost) of each row; the next is infinite where there is one language."""
    if not costs.shape[1]:
        return np.zeros(len(costs), int), np.full(len(costs), np.inf), np.full(len(costs), np.inf)
    best = costs.argmin(axis=1)
    two = np.sort(np.concatenate((costs, np.full((len(costs), 1), np.inf)), axis=1), axis=1)[:, :2]
    return best, two[:, 0], two[:, 1]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows of ``docs``: a sample of at most SAMPLE_CHARS characters of every language.

    Distinct texts are counted by label over all rows, so copies do not thin out
    the sample; then about SAMPLE_DOCS texts a language (all where there are no
    more), chosen by a hash of the text, give their first SAMPLE_PART characters.
    A language all of whose labelled texts lack letters is not learned.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("texts")).withColumnRenamed("lang", "name")
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    limit = F.ceil(F.lit(SAMPLE_DOCS * (1 << 20)) / F.col("texts"))
    few = sizes.count() <= SHIPPED_LANGUAGES
    drawn = labelled.withColumn("spot", spot).join(F.broadcast(sizes) if few else sizes, F.col("lang") == F.col("name")).where(F.col("spot") < limit)
    parts = drawn.select("lang", "spot", F.left("text", F.lit(SAMPLE_PART)).alias("part")).distinct().groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("spot", "part"))).alias("parts"))
    rows = parts.select("lang", F.slice("parts", 1, 4 * SAMPLE_DOCS).alias("parts")).collect()
    samples = {r["lang"]: [p["part"] for p in r["parts"]] for r in rows}
    return Model({lang: parts for lang, parts in samples.items() if any(_letters(normalise(parts)[0]))})


@lru_cache(maxsize=1)
def _held(raw: bytes) -> Model:
    """The model of a worker: built once, however many tasks it runs."""
    return pickle.loads(raw)


def predict(docs: DataFrame, model: Model, id_cols: list[str], text_col: str | None = "text", field: str | None = None) -> DataFrame:
    """``id_cols`` with lang_pred, score and n_letters of every row; ``und`` and 0 for null texts, texts without letters, and all texts if no language was learned.

    The score is one less the winner's cost over the runner-up's, 1 if there is
    no other language. No id column may have one of the three names. With
    ``field`` the text is that field of the first id column, a struct.
    """
    passes = model.passes()
    text = F.col(id_cols[0]).getField(field) if field else F.col(text_col)
    if len(passes) == 1:
        return _costed(docs, passes[0], id_cols, text).select(*id_cols, *_verdict(F.col("first"), F.col("cost"), F.col("next"), F.col("n_letters")))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(docs.select(F.struct(*id_cols).alias("ids"), text.alias("text"), F.monotonically_increasing_id().alias("n")), "texts")
    found = None
    for k, part in enumerate(passes):
        one = scratch.table(_costed(rows, part, ["n"], F.col("text")), f"pass-{k}")
        found = one if found is None else found.unionByName(one)
    # the least of the firsts wins; the runner-up is the least of its own next and the other passes' firsts
    firsts = F.array_sort(F.collect_list(F.struct("cost", "first", "next")))
    merged = found.groupBy("n").agg(firsts.alias("f"), F.max("n_letters").alias("n_letters"))
    rest = F.array_min(F.concat(F.array(F.col("f")[0]["next"]), F.transform(F.slice("f", 2, len(passes)), lambda x: x["cost"])))
    merged = merged.select("n", *_verdict(F.col("f")[0]["first"], F.col("f")[0]["cost"], rest, F.col("n_letters")))
    return rows.select("n", "ids").join(merged, "n").select("ids.*", "lang_pred", "score", "n_letters")


def _verdict(first: Column, cost: Column, following: Column, letters: Column) -> list[Column]:
    some = (letters > 0) & first.isNotNull()
    score = F.when(following == float("inf"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - cost / following))
    return [F.when(some, first).otherwise("und").alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"), letters.alias("n_letters")]


def _costed(docs: DataFrame, model: Model, id_cols: list[str], text: Column) -> DataFrame:
    """``id_cols`` with first (language of least cost), cost, next (the runner-up's cost) and n_letters. Only texts reach the workers."""
    raw = pickle.dumps(model)
    fields = [pa.field("first", pa.string()), pa.field("cost", pa.float64()), pa.field("next", pa.float64()), pa.field("n_letters", pa.int64())]

    def parse(texts: pa.Array) -> pa.Array:
        own = _held(raw)
        langs = np.array([*own.languages, None], object)
        ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, parts = 0, []
        while begin < len(texts):
            base = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, base + SLICE_CHARS, "right")), begin + 1)
            costs, letters = own.costs([t or "" for t in texts.slice(begin, end - begin).to_pylist()])
            best, cost, following = best_two(costs)
            first = langs[best] if own.languages else np.full(len(best), None)
            parts.append(pa.StructArray.from_arrays([pa.array(first, pa.string()), pa.array(cost), pa.array(following), pa.array(letters.astype(np.int64))], fields=fields))
            begin = end
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    # a deterministic function would run once more in each filter on its result
    udf = F.arrow_udf(parse, "first string, cost double, next double, n_letters bigint").asNondeterministic()
    return docs.select(*id_cols, udf(text.cast("string")).alias("_siftline_found")).select(*id_cols, "_siftline_found.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, n_letters) of every row, learned from the rows not held out.

    Ties between languages go to the first by name. With no labelled rows all
    are ``und``; repeated rows are judged each; an empty table gives an empty
    result; other columns are not read.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, [id_col, "held_out"], text_col)
