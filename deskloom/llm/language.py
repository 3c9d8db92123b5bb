"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of 0 to ORDER bytes holds how often each
byte followed. A byte costs -log2 of its share in its longest known context; where
it never followed, the context's escape is paid and the next shorter one asked
(escape method C: as many escapes as different bytes, no exclusion; below order 0
all 256 bytes are alike). The statistics are frozen after training, so a text's
code length is the sum of its bytes' costs, and the language with the shortest
code is the prediction.

The trees of all languages are merged into one table for each order. A context of
k bytes with the byte after it is one entry, with its full cost for every
language, so that most bytes take one look-up for all languages at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.shared import stored, uniform, worker_cache

#: Bytes of the longest context.
ORDER = 4
#: Documents of each language from which the trees are counted, about; all of them where there are fewer.
TRAIN_DOCS = 1500
#: Costs (contexts by languages) of a table, about; with more, languages are modelled in groups, of which each scores all documents.
MOST_COSTS = 1 << 23
#: Bytes of text scored at once.
CHUNK = 1 << 18
#: Rows that a worker scores at once.
ROWS = 400
#: Code length in bits a byte above which a text counts as none of the languages, where documents are rejected.
MOST_BITS = 7.0

#: The columns that identification makes.
MADE = ("lang_pred", "score", "bits_per_byte")
#: What stands before a text's first byte.
_START = b"\n" * ORDER


def _codes(text: bytes, order: int) -> np.ndarray:
    """For each byte, its context of order bytes and itself as one number. text starts with ORDER bytes of context."""
    b = np.frombuffer(text, np.uint8)
    out = np.zeros(len(b) - ORDER, np.uint64)
    for i in range(ORDER - order, ORDER + 1):
        out <<= np.uint64(8)
        out |= b[i : len(b) - ORDER + i]
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, code, n) of each batch's texts."""
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            codes, n = [], []
            for text in group["text"]:
                c, k = np.unique(_codes(_START + text.encode("utf-8", "replace"), ORDER), return_counts=True)
                codes.append(c)
                n.append(k)
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "code": code.view(np.int64), "n": np.bincount(at, np.concatenate(n)).astype(np.int64)})


class _Table:
    """Numbers and their rows, in a hash table of linear probing that is asked for many numbers at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.rows[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[at[put]], self.rows[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._place(keys)
        out = np.where(self.slots[at] == keys, self.rows[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            row = self.rows[at]
            hit = (row >= 0) & (self.slots[at] == keys[open_])
            out[open_[hit]] = row[hit]
            more = (row >= 0) & ~hit
            open_, at = open_[more], at[more]
        return out


class PpmModel:
    """Frozen statistics of all languages: for each order the known codes, their costs, and their escapes as contexts."""

    def __init__(self, languages: list[str], codes: np.ndarray, counts: np.ndarray):
        """codes: contexts of ORDER bytes with the byte after them; counts: a row for each code, a column for each language."""
        self.languages, self.codes, self.costs, self.escapes = languages, [], [], []
        levels = []
        for order in range(ORDER, -1, -1):
            low, at = np.unique(codes & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.zeros((len(low), len(languages)))
            np.add.at(n, at, counts)
            levels.append((low, n))
        below = np.full((1, len(languages)), 8.0)
        for order, (low, n) in enumerate(reversed(levels)):
            context, at = np.unique(low >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), n.shape[1])), np.zeros((len(context), n.shape[1]))
            np.add.at(total, at, n)
            np.add.at(kinds, at, n > 0)
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, kinds, 1) / np.where(known, total + kinds, 1)), 0.0)
            if order:
                shorter = np.searchsorted(self.codes[-1], low & np.uint64((1 << 8 * order) - 1))
                under = below[shorter]
            else:
                under = below[np.zeros(len(low), int)]
            own = -np.log2(np.where(n > 0, n, 1) / np.where(n > 0, (total + kinds)[at], 1))
            below = np.where(n > 0, own, escape[at] + under)
            self.codes.append(low)
            self.costs.append(below.astype(np.float32))
            self.escapes.append((context, escape.astype(np.float32)))

    def prepared(self) -> PpmModel:
        """With the hash tables, which aren't shipped."""
        if not hasattr(self, "tables"):
            self.tables = [_Table(c) for c in self.codes]
            self.contexts = [_Table(c) for c, _ in self.escapes]
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "contexts")}

    def byte_costs(self, text: bytes) -> np.ndarray:
        """Bits of each byte for each language. text starts with ORDER bytes of context."""
        code = _codes(text, ORDER)
        row = self.tables[ORDER].find(code)
        cost = self.costs[ORDER][row]
        left = np.flatnonzero(row < 0)
        cost[left] = 0
        for order in range(ORDER, -1, -1):
            if not len(left):
                return cost
            context = (code[left] & np.uint64((1 << 8 * (order + 1)) - 1)) >> np.uint64(8)
            at = self.contexts[order].find(context)
            cost[left] += np.where(at[:, None] >= 0, self.escapes[order][1][at], 0)
            if order:
                row = self.tables[order - 1].find(code[left] & np.uint64((1 << 8 * order) - 1))
                cost[left[row >= 0]] += self.costs[order - 1][row[row >= 0]]
                left = left[row < 0]
            else:
                cost[left] += 8.0
        return cost

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text for each language."""
        out = np.zeros((len(texts), len(self.languages)))
        pending, owners, size = [], [], 0

        def flush() -> None:
            if not pending:
                return
            cost = self.byte_costs(b"".join(pending))
            # the context bytes between two pieces are coded too, but not counted
            ends = np.cumsum([len(p) for p in pending]) - ORDER
            starts = np.concatenate(([0], ends[:-1] + ORDER))
            bounds = np.stack((starts, ends), 1).ravel()
            sums = np.add.reduceat(np.concatenate((cost, np.zeros((1, cost.shape[1]), np.float32))), bounds, axis=0, dtype=np.float64)[::2]
            np.add.at(out, owners, sums)
            pending.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                pending.append((text[at - ORDER : at] if at else _START) + text[at : at + CHUNK])
                owners.append(i)
                size += len(pending[-1])
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        return out


class PpmModels:
    """The models of all languages, in groups that are made when they are asked for."""

    def __init__(self, groups: list[list[str]], counted: DataFrame | None):
        """groups: all languages, sorted; counted: (lang, code, n) by the language's place among them."""
        self.groups, self.counted, self.held = groups, counted, None
        self.languages = [x for group in groups for x in group]

    def parts(self) -> Iterator[PpmModel]:
        """The model of each group."""
        if self.held is not None:
            yield from self.held
            return
        at = 0
        for group in self.groups:
            counted = self.counted.where((F.col("lang") >= at) & (F.col("lang") < at + len(group))).toArrow()
            codes, row = np.unique(counted["code"].to_numpy().view(np.uint64), return_inverse=True)
            counts = np.zeros((len(codes), len(group)), np.float32)
            counts[row, counted["lang"].to_numpy() - at] = counted["n"].to_numpy()
            yield PpmModel(group, codes, counts)
            at += len(group)

    def prepared(self) -> PpmModels:
        """With all models in memory."""
        self.held = [part.prepared() for part in self.parts()]
        return self

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text for each language."""
        return np.hstack([np.zeros((len(texts), 0)), *(part.prepared().code_lengths(texts) for part in self.parts())])


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS, seed: int = 5) -> PpmModels:
    """Models of all languages of docs (doc_id, text, lang); rows without text or lang aren't used.

    The trees are counted from whole texts of about most_docs documents of each
    language, chosen by a hash of doc_id. The driver gets the names of the
    languages and, for one group of them after the other, the counts of their
    contexts, which MOST_COSTS or that number for one language bounds.
    """
    labelled = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return PpmModels([], None)
    plan = docs.sparkSession.createDataFrame([(lang, i, min(1.0, most_docs / n)) for i, (lang, n) in enumerate(sizes)], "lang string, number int, share double")
    chosen = labelled.join(F.broadcast(plan), "lang").where(uniform(F.col("doc_id"), F.col("text"), seed=seed) < F.col("share")).select(F.col("number").alias("lang"), "text")
    counted = stored(chosen.mapInPandas(_counts, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "contexts")
    codes = {r["lang"]: r["codes"] for r in counted.groupBy("lang").agg(F.count("*").alias("codes")).collect()}
    groups, rows = [], 0
    for i, (lang, _) in enumerate(sizes):
        rows += codes.get(i, 0)
        if not groups or rows * (len(groups[-1]) + 1) > MOST_COSTS:
            groups.append([])
            rows = codes.get(i, 0)
        groups[-1].append(lang)
    return PpmModels(groups, counted)


def _coded(docs: DataFrame, model: PpmModel) -> DataFrame:
    """docs with the best of model's languages, its bits, all languages' probabilities as multiples of its own, and bytes; a text without a letter has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("language")
        m = shared.value.prepared()
        for batch in (whole.iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            raw = [t.encode("utf-8", "replace") if t is not None and any(map(str.isalpha, t)) else b"" for t in batch["text"]]
            bits = m.code_lengths(raw)
            least = bits.min(axis=1, initial=np.inf)
            names = np.array(m.languages, object)[bits.argmin(axis=1)]
            yield batch.assign(__best=names, __bits=least, __sum=np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), __bytes=[len(t) for t in raw])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{fields}, __best string, __bits double, __sum double, __bytes long")


def identify_language(docs: DataFrame, model: PpmModels) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte for each row of docs (doc_id, text); other columns stay, and those of these names are replaced.

    lang_pred: the language with the shortest code, of equal ones the first by
    name; und for null texts, texts without a letter, or a model without
    languages. score: the language's share in the probabilities of all languages
    that follow from the code lengths; 0 for und.

    Several groups of languages score the rows one after the other, and their
    results are joined to the rows by a number that is stored with them.
    """
    docs = docs.drop(*MADE)
    if len(model.groups) > 1:
        docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        texts, parts = docs.select("__row", "text"), None
        for i, part in enumerate(model.parts()):
            found = stored(_coded(texts, part).select("__row", "__bytes", F.struct("__bits", F.lit(i).alias("group"), "__best", "__sum").alias("part")), "codes")
            parts = found if parts is None else parts.unionByName(found)
        first = parts.groupBy("__row").agg(F.first("__bytes").alias("__bytes"), F.min("part").alias("first"), F.collect_list("part").alias("all"))
        total = F.aggregate("all", F.lit(0.0), lambda s, p: s + p["__sum"] * F.pow(F.lit(2.0), F.greatest(F.col("first.__bits") - p["__bits"], F.lit(-1000.0))))
        docs = docs.join(first.select("__row", "__bytes", "first.__best", "first.__bits", total.alias("__sum")), "__row").drop("__row")
    elif model.groups:
        docs = _coded(docs, next(model.parts()))
    else:
        docs = docs.withColumns({"__best": F.lit("und"), "__bits": F.lit(0.0), "__sum": F.lit(1.0), "__bytes": F.lit(0)})
    known = F.col("__bytes") > 0
    made = {
        "lang_pred": F.when(known, F.col("__best")).otherwise("und"),
        "score": F.when(known, 1 / F.col("__sum")).otherwise(0.0),
        "bits_per_byte": F.when(known, F.col("__bits") / F.col("__bytes")).otherwise(0.0),
    }
    return docs.withColumns(made).drop("__best", "__bits", "__sum", "__bytes")


def in_a_language(docs: DataFrame, model: PpmModels, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that the model takes for one of its languages, with docs' columns alone.

    Rejected are und, and texts that cost more than most_bits a byte in every language.
    """
    own = docs.columns
    found = identify_language(docs.withColumnsRenamed({c: f"__own_{c}" for c in own if c not in ("doc_id", "text")}), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= most_bits))
    return kept.drop(*MADE).withColumnsRenamed({f"__own_{c}": c for c in own}).select(*own)


def held_out() -> Column:
    """Whether a document is kept from training: the remainder of the checksum of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for all docs (doc_id, text, lang), learned from those not held out."""
    model = train(docs.where(~held_out()))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
