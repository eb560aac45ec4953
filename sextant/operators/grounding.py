"""References, completeness of context, and lexical grounding of answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.runtime import latest, latest_lean, materialise, row_counts, row_groups, rows_between

#: Printed kinds of reference and the prefix of the unit they mean.
KINDS = [("Article", "art", r"\d+"), ("Annex", "anx", r"\d+"), ("Recital", "rct", r"\d+"), ("Section", "sec", r"\d+\.\d+"), ("Action", "act", r"[A-Z]{2}-?\d+\.\d+-+\d{3}")]
SUBCATEGORY = r"\b([A-Z]{4,}) (\d+\.\d+)\b"
#: Nouns of outside instruments; a reference "of the ..." to one is external.
EXTERNAL = r"(?!\s*(?:\([^)]*\)\s*)*of\s+(?:the\s+)?(?:Directive|Regulation|Norm|Bulletin|Charter|Convention|Treaty|Decision))"


def _prefixed(kind: str):
    return lambda x: F.concat(F.lit(f"{kind}|"), x)


def surfaces(text: Column) -> Column:
    """Distinct printed references of a text as ``kind|number``, kinds in fixed order; external ones left out."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(rf"\b{k} ({n})\b{EXTERNAL}"), 1), _prefixed(p)) for k, p, n in KINDS]
    subs = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{4,} \d+\.\d+)\b"), 1), lambda x: F.concat(F.lit("sub|"), F.translate(x, " ", "_")))
    return F.array_distinct(F.concat(*found, subs))


def candidate_units(surface: Column, docs: Column) -> Column:
    """Units a reference may mean: that kind and number in each of the given documents."""
    name = F.concat(F.substring_index(surface, "|", 1), F.lit("_"), F.regexp_replace(F.substring_index(surface, "|", -1), "-+", "-"))
    return F.transform(docs, lambda d: F.concat(d, F.lit(":"), name))


def extracts(user_text: Column) -> Column:
    """The extracts of a request's text, each rendered as ``[id] label`` and its text."""
    body = F.regexp_replace(F.regexp_replace(user_text, r"(?s)\n*Question:.*$", ""), r"(?s)^\s*Extracts:\s*", "")
    return F.filter(F.split(body, r"\n\n(?=\[)"), lambda b: b.rlike(r"^\[[^\]]+\]"))


def context_blocks(requests: DataFrame) -> DataFrame:
    """(custom_id, pos, unit_id, block): the extracts a request carries."""
    return requests.select("custom_id", F.posexplode(extracts(F.col("user_text"))).alias("pos", "block")).select("custom_id", "pos", T.unit_of(F.regexp_extract("block", r"^\[([^\]]+)\]", 1)).alias("unit_id"), "block")


def assess(requests: DataFrame, units: DataFrame) -> DataFrame:
    """(custom_id, unit, first_pos, resolved, in_context): every unit a request's context refers to.

    References are read in order of the blocks, first occurrence kept; candidates stand in the block's own document.
    """
    blocks = context_blocks(requests)
    refs = blocks.select("custom_id", "pos", F.explode(surfaces(F.col("block"))).alias("s"), F.substring_index("unit_id", ":", 1).alias("doc"))
    cand = refs.select("custom_id", "pos", F.explode(candidate_units(F.col("s"), F.array("doc"))).alias("unit")).groupBy("custom_id", "unit").agg(F.min("pos").alias("first_pos"))
    known = units.select(F.col("unit_id").alias("unit")).distinct().withColumn("resolved", F.lit(True))
    here = blocks.select("custom_id", F.col("unit_id").alias("unit")).distinct().withColumn("in_context", F.lit(True))
    return cand.join(known, "unit", "left").join(here, ["custom_id", "unit"], "left").select("custom_id", "unit", "first_pos", F.coalesce("resolved", F.lit(False)).alias("resolved"), F.coalesce("in_context", F.lit(False)).alias("in_context"))


def augmented(requests: DataFrame, units: DataFrame) -> DataFrame:
    """(custom_id, pos, unit, origin): the first pass unmodified, then the absent units in order of discovery."""
    blocks = context_blocks(requests).select("custom_id", F.col("pos").cast("long").alias("pos"), F.col("unit_id").alias("unit"), F.lit("first").alias("origin"))
    n = blocks.groupBy("custom_id").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    more = assess(requests, units).filter("resolved AND NOT in_context").join(n, "custom_id")
    w = W.partitionBy("custom_id").orderBy("first_pos", "unit")
    return blocks.unionByName(more.select("custom_id", (F.col("n") + F.row_number().over(w) - 1).alias("pos"), "unit", F.lit("fetched").alias("origin")))


def window_score(unit: list, block: list) -> float:
    """Best share of the unit's tokens, as a multiset, inside any window of its length; 0 for a shorter block or an empty unit.

    Each token of the block that the unit has counts for an interval of window starts: those that reach it and hold fewer
    of its kind before it than the unit needs. The best window is where most intervals lie over one another.
    """
    n, last = len(unit), len(block) - len(unit)
    if not n or last < 0:
        return 0.0
    need, places = Counter(unit), {}
    edges = [0] * (last + 2)
    for i, t in enumerate(block):
        k = need.get(t)
        if k is None:
            continue
        mine = places.setdefault(t, [])
        low = max(0, i - n + 1, mine[-k] + 1 if len(mine) >= k else 0)
        mine.append(i)
        if low <= min(i, last):
            edges[low] += 1
            edges[min(i, last) + 1] -= 1
    return max(accumulate(edges)) / n


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` with (unit_tokens, block_tokens) gets ``score``, by Arrow batches; distinct pairs should come in."""

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for u, b in it:
            yield pd.Series([window_score(list(x), list(y)) for x, y in zip(u, b)], dtype="float64")

    return pairs.withColumn("score", score("unit_tokens", "block_tokens"))


def score_expression(unit: Column, block: Column) -> Column:
    """The same score as a native expression, for checking the Arrow form against."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    n = F.size(unit)
    at = F.when(F.size(block) >= n, F.sequence(F.lit(1), F.greatest(F.size(block) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(at, lambda i: F.aggregate(F.array_distinct(unit), F.lit(0), lambda s, t: s + F.least(count(unit, t), count(F.slice(block, i, n), t)))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(best / n, F.lit(0.0)))


def threshold(n: Column) -> Column:
    return F.when(n < 4, 1.0).otherwise(0.75)


def newest_requests(requests: DataFrame) -> DataFrame:
    """One row per request, the latest; of one time the one with the greatest text."""
    return latest(requests, "custom_id", ["created_at", "user_text"])


def newest_answers(answers: DataFrame) -> DataFrame:
    """One row per answer, the latest; of one time the one with the greatest digest."""
    return latest(answers, "custom_id", ["collected_at", "body_sha256"])


def lean_requests(requests: DataFrame) -> DataFrame:
    """(custom_id, query_id, user_text) of ``newest_requests`` that name a query."""
    return latest_lean(requests.select("custom_id", "query_id", "user_text", "created_at"), "custom_id", ["created_at", "user_text"]).filter("query_id IS NOT NULL").drop("created_at")


def lean_answers(answers: DataFrame) -> DataFrame:
    """(custom_id, a): text of each of ``newest_answers`` that has one."""
    a = answers.select("custom_id", T.answer_text(F.col("response")).alias("a"), "collected_at", "body_sha256")
    return latest_lean(a, "custom_id", ["collected_at", "body_sha256"]).filter("a IS NOT NULL").select("custom_id", "a")


def unit_verdicts(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(custom_id, pos, unit, n_tokens, n_surfaces, overlap_max, score, grounded) per claim unit of an answer.

    A block counts for ``score`` only if it prints every reference the unit prints; ``overlap_max`` takes all blocks.
    Units without an admitted block score 0. Of second deliveries of an answer or request the latest counts.
    """
    a = newest_answers(answers).select("custom_id", T.answer_text(F.col("response")).alias("a")).filter("a IS NOT NULL")
    u = a.select("custom_id", F.posexplode(T.claim_units(F.col("a"))).alias("pos", "unit")).select("custom_id", "pos", "unit", T.primary_tokens(F.col("unit")).alias("unit_tokens"), surfaces(F.col("unit")).alias("us"))
    b = context_blocks(newest_requests(requests)).select("custom_id", T.primary_tokens(F.col("block")).alias("block_tokens"), surfaces(F.col("block")).alias("bs"))
    s = scored(u.join(b, "custom_id")).withColumn("admitted", F.size(F.array_except("us", "bs")) == 0)
    best = s.groupBy("custom_id", "pos").agg(F.max("score").alias("overlap_max"), F.max(F.when(F.col("admitted"), F.col("score"))).alias("score"))
    full = u.join(best, ["custom_id", "pos"], "left").select("custom_id", "pos", "unit", F.size("unit_tokens").alias("n_tokens"), F.size("us").alias("n_surfaces"), F.coalesce("overlap_max", F.lit(0.0)).alias("overlap_max"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return full.withColumn("grounded", (F.col("n_tokens") > 0) & (F.col("score") >= threshold(F.col("n_tokens"))))


def answer_grading(verdicts: DataFrame) -> DataFrame:
    """(custom_id, n_units, n_grounded, n_ungrounded, unsupported_rate)."""
    g = verdicts.groupBy("custom_id").agg(F.count("*").alias("n_units"), F.sum(F.col("grounded").cast("long")).alias("n_grounded"))
    return g.select("custom_id", "n_units", "n_grounded", (F.col("n_units") - F.col("n_grounded")).alias("n_ungrounded"), F.bround(1 - F.col("n_grounded") / F.col("n_units"), 6).alias("unsupported_rate"))


class BlockIndex:
    """Blocks by token: for each token and number of times the set of blocks that hold it so often, as bits over blocks.

    Sets of at least a 128th of the blocks are kept, so their number is bounded by the blocks' lengths, not by the vocabulary.
    """

    def __init__(self, tokens: pa.ListArray, only: list, wide: int = 256) -> None:
        self.n, self.wide, self.words = len(tokens), wide, -(-len(tokens) // 64)
        self.size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        coded = tokens.flatten().dictionary_encode()
        self.ids = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        # in place, as a task's memory is mostly these columns
        key = self.codes.astype(np.int64)
        key *= self.n
        key += np.repeat(np.arange(self.n, dtype=np.int32), self.size)
        key.sort()
        run, self.nth = np.arange(len(key), dtype=np.int32), np.arange(len(key), dtype=np.int32)
        run[1:][key[1:] == key[:-1]] = 0
        self.nth -= np.maximum.accumulate(run, out=run)
        del run
        self.at = np.searchsorted(key, np.arange(len(self.ids) + 1) * self.n)
        key %= max(self.n, 1)
        self.block = key.astype(np.int32)
        del key
        self.kept: dict[tuple[int, int], tuple[int, np.ndarray | None]] = {}
        self.longer: dict[int, np.ndarray] = {}
        self.own: dict[str, list[int]] = {}
        for i, q in enumerate(only):
            if q is not None:
                self.own.setdefault(q, []).append(i)

    def bits(self, of: np.ndarray) -> np.ndarray:
        m = np.zeros(self.words * 64, dtype=bool)
        m[of] = True
        return np.packbits(m, bitorder="little").view("<u8")

    def holding(self, token: int, times: int) -> tuple[int, np.ndarray | None]:
        """How many blocks hold ``token`` at least ``times`` times, and which; None for none."""
        if (token, times) in self.kept:
            return self.kept[token, times]
        part = slice(self.at[token], self.at[token + 1])
        b = self.block[part][self.nth[part] == times - 1]
        found = len(b), self.bits(b) if len(b) else None
        if not len(b) or 128 * len(b) >= self.n:
            self.kept[token, times] = found
        return found

    def members(self, bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, col = np.nonzero(np.unpackbits(bits[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return at[row] * 64 + col

    def within(self, some: np.ndarray, need: Counter, n: int) -> np.ndarray:
        """Bound of the windows' counts for blocks up to ``wide`` tokens: places of any token of the unit in a window."""
        width = max(int(self.size[some].max(initial=0)), n)
        place = np.arange(width)[None, :]
        mine = np.zeros(len(self.ids) + 1, dtype=np.int32)
        mine[[t for t in need if t >= 0]] = 1
        code = np.where(place < self.size[some][:, None], self.codes[np.minimum(self.start[some][:, None] + place, max(len(self.codes) - 1, 0))], len(self.ids))
        sums = np.zeros((len(some), width + 1), dtype=np.int32)
        np.cumsum(mine[code], axis=1, out=sums[:, 1:])
        return (sums[:, n:] - sums[:, : width + 1 - n]).max(axis=1)

    def best(self, query: str, unit: list, best: int = 0) -> int:
        """Most tokens of ``unit``, as a multiset, in a window of its length over all blocks but those of ``query`` alone; ``best`` if none has more.

        Shared tokens are counted in all blocks at once by carry-save adders over the bits, and bound the windows; blocks are
        scored from the highest count down to the best window found. Where ``best`` leaves few tokens to miss, the rarest ones
        are counted and the others taken for held, unless too many blocks pass.
        """
        n, code = len(unit), [self.ids.get(t, -1 - i) for i, t in enumerate(unit)]
        need = Counter(code)
        rows = sorted((x for t, k in need.items() if t >= 0 for j in range(k) if (x := self.holding(t, j + 1))[0]), key=lambda x: x[0])
        if len(rows) <= best:
            return best
        if n not in self.longer:
            self.longer[n] = self.bits(np.flatnonzero(self.size >= n))
        free = self.longer[n]
        if query in self.own:
            free = free.copy()
            for i in self.own[query]:
                free[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        for few in (True, False):
            used = min(len(rows), len(rows) - best + 4) if few else len(rows)
            rest = len(rows) - used
            planes = added([x for _, x in rows[:used]])
            at, count = free, 0
            for p in range(len(planes) - 1, -1, -1):
                if (x := at & planes[p]).any():
                    at, count = x, count | 1 << p
            while count + rest > best:
                held = np.flatnonzero(at)
                if rest and len(held) > 64:
                    break
                for k in range(0, len(held), 64):
                    some = self.members(at, held[k : k + 64])
                    if len(some) > 4:
                        narrow = self.size[some] <= self.wide
                        keep = ~narrow
                        keep[narrow] = self.within(some[narrow], need, n) > best
                        some = some[keep]
                    for i in some:
                        best = max(best, round(window_score(code, self.codes[self.start[i] : self.start[i] + self.size[i]].tolist()) * n))
                        if best >= count + rest:
                            return best
                count -= 1
                at = free
                for p, x in enumerate(planes):
                    at = at & x if count >> p & 1 else at & ~x
            else:
                return best
        return best


def added(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The binary digits, lowest first, of the number of rows that have each bit."""
    planes = []
    while rows:
        carry = []
        while len(rows) > 2:
            a, b, c = rows.pop(), rows.pop(), rows.pop()
            x = a ^ b
            carry.append(a & b | x & c)
            rows.append(x ^ c)
        if len(rows) == 2:
            a, b = rows
            carry.append(a & b)
            rows = [a ^ b]
        planes.append(rows[0])
        rows = carry
    return planes


def foreign_best(units: pd.DataFrame, blocks: pd.DataFrame, wide: int = 256) -> list[float]:
    """Best window score of each unit (query_id, unit_tokens) over all blocks (only, block_tokens) whose ``only`` is not its query."""
    index = BlockIndex(pa.array(list(blocks["block_tokens"]), pa.list_(pa.string())), list(blocks["only"]), wide)
    return [index.best(q, list(u)) / len(u) if len(u) else 0.0 for q, u in zip(units["query_id"], units["unit_tokens"])]


def own_alignment(answered: DataFrame) -> DataFrame:
    """(custom_id, pos, query_id, unit_tokens, overlap_max): each unit's best window score over the blocks of its own request; 0 without one.

    Columns: answered (custom_id, query_id, units, blocks), the last two lists of token lists, one row per answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 1024):
                b = whole.slice(k, 1024).to_pydict()
                rows = [(c, i, q, u, max((window_score(u, x) for x in blocks or []), default=0.0)) for c, q, units, blocks in zip(*(b[n] for n in ("custom_id", "query_id", "units", "blocks"))) for i, u in enumerate(units or [])]
                yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    names, kinds = ["custom_id", "pos", "query_id", "unit_tokens", "overlap_max"], [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.float64()]
    return answered.mapInArrow(run, "custom_id string, pos int, query_id string, unit_tokens array<string>, overlap_max double")


def foreign_alignment(units: DataFrame, blocks: DataFrame, unit_group: int = 49152, block_group: int = 131072) -> DataFrame:
    """``units`` without its tokens and with foreign_max: each unit's best window score over the blocks of every request of another query; 0 without one.

    Columns: units (custom_id, pos, query_id, unit_tokens) and others that are passed on, blocks (query_id, block_tokens); tokens
    hold no blank. Units and distinct blocks are written once; each task reads its share of the units and all blocks group by
    group from these files. No unit and no block is shuffled or copied for a task.
    """
    line = blocks.groupBy(F.array_join("block_tokens", " ").alias("line")).agg(F.min("query_id").alias("least"), F.max("query_id").alias("most"))
    b = materialise(line.select(F.filter(F.split("line", " "), lambda t: t != "").alias("block_tokens"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("only")))
    u = materialise(units)
    files, unit_files = sorted(b.inputFiles()), sorted(u.inputFiles())
    counts = row_counts(unit_files)
    n = -(-sum(counts) // unit_group) or 1
    share = -(-sum(counts) // n)

    def run(tasks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for t in tasks for i in t["id"].to_pylist()):
            mine = list(rows_between(unit_files, counts, i * share, (i + 1) * share))
            if not mine:
                continue
            x = pa.Table.from_batches(mine)
            query, tokens = x["query_id"].to_pylist(), x["unit_tokens"].to_pylist()
            best = [0] * len(tokens)
            for group in row_groups(files, block_group):
                index = BlockIndex(group["block_tokens"].combine_chunks(), group["only"].to_pylist())
                del group
                best = [index.best(q, t, k) for q, t, k in zip(query, tokens, best)]
            found = pa.array([k / len(t) if t else 0.0 for k, t in zip(best, tokens)], pa.float64())
            yield from x.drop_columns(["query_id", "unit_tokens"]).append_column("foreign_max", found).to_batches()

    kept = [f for f in u.schema.fields if f.name not in ("query_id", "unit_tokens")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "foreign_max double"])
    return units.sparkSession.range(0, n, 1, n).mapInArrow(run, schema)
