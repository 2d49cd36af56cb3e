"""Exact ranked searches of many queries: each task scores its rows in numpy and keeps the best per query.

A stated query set goes to the tasks in blocks, so that its size is bounded at any time; rows are scored in slices of
about SLICE scores. Only each task's best per query are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillgraph.operators.lineage import cut

#: queries that travel to all tasks at once; more of them go in further blocks
QUERY_BLOCK = 4096
SLICE = 2_000_000
#: terms of texts that are looked up at once
TERMS = 250_000


class Best:
    """The k best rows per query of scores that come in slices: by score (9 digits), then by ties, then by key.

    low is what a row's score has to reach for each query: that of the k-th of the rows kept so far.
    """

    def __init__(self, k: int, queries: int, ties: tuple[tuple[str, str], ...] = ()):
        self.k, self.queries, self.held, self.parts = k, queries, 0, []
        self.order = [("q", "ascending"), ("r", "descending"), *ties, ("key", "ascending")]
        self.low = np.full(queries, -np.inf)

    def add(self, keys: pa.Array, score: np.ndarray) -> None:
        """score: rows x queries, -inf where a row doesn't count."""
        r = np.round(score, 9)
        row, col = self.fitting(r, slice(None), 0.0)
        self.keep(col, r[row, col], score[row, col], {"key": keys.take(pa.array(row))})

    def fitting(self, r: np.ndarray, at: np.ndarray | slice, error: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns that may be among the best, where r (rows x queries at) is off by up to error."""
        least = self.low[at] - error
        if len(r) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(r, len(r) - self.k, axis=0)[len(r) - self.k] - 2 * error)
        return np.nonzero((r >= np.maximum(least, np.finfo(float).min).astype(r.dtype)) & (r > -np.inf))

    def keep(self, col: np.ndarray, r: np.ndarray, score: np.ndarray, columns: dict[str, pa.Array]) -> None:
        if not len(col):
            return
        self.parts.append(pa.table({"q": pa.array(col.astype(np.int32)), "r": pa.array(r), "score": pa.array(score), **columns}))
        self.held += len(col)
        if len(self.parts) == 1 or self.held > 2 * self.k * self.queries + 50_000:
            self.parts = [self.found()]
            self.held = self.parts[0].num_rows
            q, r = (self.parts[0].column(c).to_numpy() for c in ("q", "r"))
            full = np.bincount(q, minlength=self.queries) >= self.k
            last = np.searchsorted(q, np.arange(self.queries), "right") - 1
            self.low = np.where(full, r[last], self.low)

    def found(self) -> pa.Table | None:
        if not self.parts:
            return None
        t = pa.concat_tables(self.parts).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=self.order))
        q = t.column("q").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return t.filter(pa.array(place < self.k))

    def batches(self, names: list, key: str, more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
        t = self.found()
        if t is not None and t.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(names).take(t.column("q").combine_chunks()), *[t.column(c).combine_chunks() for c in ("key", "score", *more)]], ["query_id", key, "score", *more])


class Access:
    """Which rows (each with a list of users) count for which queries (each of a user)."""

    def __init__(self, users: list):
        self.names = pa.array(sorted({u for u in users if u is not None}), pa.string())
        place = {u: i for i, u in enumerate(self.names.to_pylist())}
        self.of = np.array([place.get(u, len(place)) for u in users], np.int64)

    def mask(self, column: pa.Array) -> np.ndarray:
        """rows x queries."""
        row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        user = pc.fill_null(pc.index_in(column.flatten(), value_set=self.names), len(self.names)).to_numpy(zero_copy_only=False)
        may = np.zeros((len(column), len(self.names) + 1), bool)
        may[row, user] = True
        may[:, -1] = False
        return may[:, self.of]


def blocks(queries: DataFrame, *columns: str) -> Iterator[list]:
    """The rows of a stated query set, in blocks."""
    block: list = []
    for row in queries.select(*columns).toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


class Sized:
    """Queries' vectors by length; of rows of another length nothing counts or, if ragged, the shorter length."""

    def __init__(self, vectors: list[np.ndarray], ragged: bool = False):
        sizes, self.ragged, self.known = np.array([len(v) for v in vectors], int), ragged, {}
        self.groups = {int(d): (at, np.stack([vectors[i] for i in at]) if d else np.zeros((len(at), 0))) for d in np.unique(sizes) for at in [np.flatnonzero(sizes == d)]}

    def units(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, their unit vectors, the same as floats of 32 bits), cut to the size of rows."""
        for d, (at, q) in self.groups.items():
            n = min(d, size)
            if n != max(d, size) and not self.ragged:
                continue
            if (d, n) not in self.known:
                unit = units(q[:, :n])
                self.known[d, n] = (at, unit, np.ascontiguousarray(unit, np.float32))
            yield self.known[d, n]


def units(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n > 0, n, 1)[:, None]


def vectors_by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) of each length; null counts as empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), d) if d else np.zeros((len(rows), 0))


def cosines_of(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, row by row, the same for the same pair wherever it stands."""
    return np.nan_to_num(np.concatenate([(v[a : a + 50_000] * q[a : a + 50_000]).sum(1) for a in range(0, max(1, len(v)), 50_000)]))


def nearest(source: DataFrame, queries: DataFrame, k: int, key: str, restricted: bool, carry: tuple[tuple[str, str | None], ...] = (), ragged: bool = False, weight: float = 1.0, bonus: str | None = None, floor: float = -np.inf) -> DataFrame | None:
    """(query_id, key, score, carried columns): each task's k best by cosine. source: key, vector and, if restricted,
    users array<string>, then the carried columns (name and, where it decides ties, the order).

    Vectors of another length than the query's have no score unless ragged. With a bonus (a carried column) rows are
    ranked by weight * cosine + bonus; cosines below the floor don't count. Products of 32 bits find what may be among
    the best, within their error bound; these pairs are computed again in doubles.
    """
    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c, _ in carry)
    kind = f"query_id string, {key} {source.schema[key].dataType.simpleString()}, score double{kinds}"
    names_of, ties = tuple(c for c, _ in carry), tuple((c, o) for c, o in carry if o)
    found = None
    for block in blocks(queries, "query_id", "user_id", "vector"):
        if found is None and len(block) == QUERY_BLOCK:
            source = cut(source)  # further blocks read it again
        sent = source.sparkSession.sparkContext.broadcast(([r["query_id"] for r in block], [r["user_id"] for r in block], [np.array([] if r["vector"] is None else r["vector"], float) for r in block]))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, users, vectors = sent.value
            sized, top, access = Sized(vectors, ragged), Best(k, len(names), ties), Access(users) if restricted else None
            step = max(1, SLICE // len(names))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    may = access.mask(part.column(2)) if access is not None else None
                    more = part.column(part.schema.get_field_index(bonus)).to_numpy(zero_copy_only=False) if bonus else None
                    for rows, v in vectors_by_size(part.column(1)):
                        for at, q, short in sized.units(v.shape[1]):
                            n = q.shape[1]
                            own, error = units(v[:, :n]), (n + 8) * 2.4e-7
                            s = np.nan_to_num(own.astype(np.float32) @ short.T)
                            wanted = None if np.isneginf(floor) else s >= floor - error
                            if bonus:
                                s = (weight * s + more[rows][:, None]).astype(np.float32)
                            if wanted is not None:
                                s[~wanted] = -np.inf
                            if may is not None:
                                s[~(may[rows] if len(at) == len(names) else may[np.ix_(rows, at)])] = -np.inf
                            i, j = top.fitting(s, at, error)
                            raw = cosines_of(own[i], q[j]) if len(i) else np.zeros(0)
                            ok = raw >= floor
                            i, j, raw = i[ok], j[ok], raw[ok]
                            r = np.round(weight * raw + more[rows[i]] if bonus else raw, 9)
                            place = pa.array(rows[i])
                            top.keep(at[j], r, raw, {"key": part.column(0).take(place), **{c: part.column(part.schema.get_field_index(c)).take(place) for c in names_of}})
            yield from top.batches(names, key, names_of)

        part = source.mapInArrow(best, kind)
        found = part if found is None else found.unionByName(part)
    return found


def best_of_records(chunks: DataFrame, queries: DataFrame) -> DataFrame | None:
    """(query_id, virtual_record_id, point_id, score): of each record that a query names, each task's best chunk by
    cosine, then by point_id. chunks: virtual_record_id, point_id, embedding; queries: query_id, vector, records."""
    record, point = (chunks.schema[c].dataType.simpleString() for c in ("virtual_record_id", "point_id"))
    kind = f"query_id string, virtual_record_id {record}, point_id {point}, score double"
    found = None
    for block in blocks(queries, "query_id", "vector", "records"):
        wanted: dict = {}
        for i, row in enumerate(block):
            for r in row["records"]:
                wanted.setdefault(r, []).append(i)
        names = list(wanted)
        pairs = [np.array(wanted[r]) for r in names]
        if found is None and len(block) == QUERY_BLOCK:
            chunks = cut(chunks)  # further blocks read it again
        sent = chunks.sparkSession.sparkContext.broadcast(([r["query_id"] for r in block], [np.array([] if r["vector"] is None else r["vector"], float) for r in block], names, pairs))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asking, vectors, names, pairs = sent.value
            known, sized = pa.array(names), {}
            first = np.concatenate([[0], np.cumsum([len(p) for p in pairs])])
            top = Best(1, int(first[-1]))
            for batch in batches:
                of = pc.fill_null(pc.index_in(batch.column(0).cast(known.type), value_set=known), -1).to_numpy(zero_copy_only=False)
                order = np.argsort(of, kind="stable")
                order = order[of[order] >= 0]
                for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                    n = int(of[rows[0]])
                    if n not in sized:
                        if len(sized) > 256:
                            sized.clear()
                        sized[n] = Sized([vectors[i] for i in pairs[n]], True)
                    for a in range(0, len(rows), step := max(1, SLICE // len(pairs[n]))):
                        part = batch.take(pa.array(rows[a : a + step]))
                        for own, v in vectors_by_size(part.column(2)):
                            for at, q, short in sized[n].units(v.shape[1]):
                                u, error, at = units(v[:, : q.shape[1]]), (q.shape[1] + 8) * 2.4e-7, at + first[n]
                                i, j = top.fitting(np.nan_to_num(u.astype(np.float32) @ short.T), at, error)
                                raw = cosines_of(u[i], q[j])
                                top.keep(at[j], raw, raw, {"key": part.column(1).take(pa.array(own[i]))})
            t = top.found()
            if t is not None and t.num_rows:
                pair = t.column("q").to_numpy()
                n = np.searchsorted(first, pair, "right") - 1
                query = np.concatenate(pairs)[pair]
                yield pa.RecordBatch.from_arrays([pa.array(asking).take(pa.array(query)), known.take(pa.array(n)), t.column("key").combine_chunks(), t.column("score").combine_chunks()], ["query_id", "virtual_record_id", "point_id", "score"])

        part = chunks.mapInArrow(best, kind)
        found = part if found is None else found.unionByName(part)
    return found


class Phrases:
    """The phrases (lists of terms) that a block of queries asks for, and how often each query asks for each."""

    def __init__(self, asked: list[tuple[int, tuple[str, ...]]]):
        numbers: dict[tuple[str, ...], int] = {}
        counts: dict[tuple[int, int], int] = {}
        for q, phrase in asked:
            p = numbers.setdefault(phrase, len(numbers))
            counts[p, q] = counts.get((p, q), 0) + 1
        self.phrases = list(numbers)
        terms = sorted({t for p in self.phrases for t in p})
        self.terms = pa.array(terms, pa.string())
        place = {t: i for i, t in enumerate(terms)}
        self.single = np.full(len(terms), -1, np.int64)
        self.longer = []
        for i, p in enumerate(self.phrases):
            codes = [place[t] for t in p]
            if len(codes) == 1:
                self.single[codes[0]] = i
            else:
                self.longer.append((i, codes))
        pairs = sorted(counts)
        self.query = np.array([q for _, q in pairs], np.int64)
        self.times = np.array([counts[x] for x in pairs], float)
        self.first = np.searchsorted(np.array([p for p, _ in pairs], np.int64), np.arange(len(self.phrases) + 1))

    def count(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts' terms: row, phrase and frequency where a phrase stands, and each row's number of terms."""
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(length)), length)
        at = np.flatnonzero(code >= 0)
        own = at[self.single[code[at]] >= 0]
        hits = [row[own] * len(self.phrases) + self.single[code[own]]]
        for i, codes in self.longer:
            start = at[code[at] == codes[0]]
            for j, c in enumerate(codes[1:], 1):
                start = start[start + j < len(code)]
                start = start[(code[start + j] == c) & (row[start + j] == row[start])]
            hits.append(row[start] * len(self.phrases) + i)
        pair, tf = np.unique(np.concatenate(hits), return_counts=True)
        return pair // max(1, len(self.phrases)), pair % max(1, len(self.phrases)), tf, length


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose lists in a column hold about ``most`` elements in all; a longer list is alone."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def counted(texts: DataFrame, phrases, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, more, length, phrase array<int>, tf array<int>) of texts (key, tokens array<string>, more)."""
    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in (key, *more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TERMS):
                row, phrase, tf, length = phrases.value.count(part.column(0))
                off = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (phrase, tf)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(length), *lists], [key, *more, "length", "phrase", "tf"])

    return texts.select("tokens", key, *more).mapInArrow(run, ", ".join([*kinds, "length long", "phrase array<int>", "tf array<int>"]))


def text_scores(asked: Phrases, row: np.ndarray, phrase: np.ndarray, tf: np.ndarray, length: np.ndarray, weight: np.ndarray, average: float, rows: int, queries: int, k1: float, b: float) -> np.ndarray:
    """BM25 as rows x queries from where a phrase stands, how often, and the length of that text."""
    share = weight[phrase] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    n = np.diff(asked.first)[phrase]
    at = np.repeat(asked.first[phrase], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.bincount(np.repeat(row, n) * queries + asked.query[at], weights=np.repeat(share, n) * asked.times[at], minlength=rows * queries).reshape(rows, queries).astype(float)  # of nothing bincount gives whole numbers


def best_of_tenant(k: int, key: str, average: float, k1: float, b: float):
    """The k best rows of one tenant (key, embedding, tokens) for its queries (query_id, vector, phrases with their
    weights), by cosine and by BM25: a function of a cogroup, which gives query_id, key, score and leg."""

    def best(mine: pa.Table, asked: pa.Table) -> pa.Table:
        mine, names, out = mine.combine_chunks(), asked.column("query_id").to_pylist(), []
        keys = mine.column(key).combine_chunks()
        if mine.num_rows and names:
            given = [i for i, v in enumerate(asked.column("vector")) if v.is_valid]
            held = mine.filter(mine.column("embedding").is_valid())
            if given and held.num_rows:
                own, top = held.column(key).combine_chunks(), Best(k, len(given))
                sized = Sized([np.array(asked.column("vector")[i].as_py(), float) for i in given])
                for rows, v in vectors_by_size(held.column("embedding").combine_chunks()):
                    u = units(v)
                    for at, q, short in sized.units(v.shape[1]):
                        i, j = top.fitting(np.nan_to_num(u.astype(np.float32) @ short.T), at, (v.shape[1] + 8) * 2.4e-7)
                        raw = cosines_of(u[i], q[j])
                        top.keep(at[j], np.round(raw, 9), raw, {"key": own.take(pa.array(rows[i]))})
                out += [("vector", x) for x in top.batches([names[i] for i in given], key)]
            said = [(i, tuple(p["p"]), p["weight"]) for i, ps in enumerate(asked.column("phrases").to_pylist()) for p in ps or []]
            if said:
                phrases, top, of = Phrases([(i, p) for i, p, _ in said]), Best(k, len(names)), {p: w for _, p, w in said}
                row, phrase, tf, length = phrases.count(mine.column("tokens").combine_chunks())
                score = text_scores(phrases, row, phrase, tf, length[row], np.array([of[p] for p in phrases.phrases]), average, mine.num_rows, len(names), k1, b)
                score[score == 0] = -np.inf
                top.add(keys, score)
                out += [("keyword", x) for x in top.batches(names, key)]
        kind = pa.schema([("query_id", pa.string()), (key, keys.type), ("score", pa.float64()), ("leg", pa.string())])
        parts = [pa.Table.from_batches([x]).append_column("leg", pa.array([leg] * x.num_rows, pa.string())).cast(kind) for leg, x in out]
        return pa.concat_tables(parts) if parts else kind.empty_table()

    return best


def best_texts(coded: DataFrame, names: list, users: list, phrases, weight: np.ndarray, average: float, k: int, key: str, restricted: bool, k1: float, b: float) -> DataFrame:
    """(query_id, key, score): each task's k best by BM25. coded: as counted() gives it, and users if restricted."""
    kind = coded.schema[key].dataType.simpleString()
    sent = coded.sparkSession.sparkContext.broadcast((names, users, weight))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, users, weight = sent.value
        asked = phrases.value
        top, access = Best(k, len(names)), Access(users) if restricted else None
        step = max(1, SLICE // len(names))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                size = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), size)
                phrase, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                length = part.column(1).to_numpy(zero_copy_only=False)[row]
                score = text_scores(asked, row, phrase, tf, length, weight, average, part.num_rows, len(names), k1, b)
                score[score == 0] = -np.inf
                if access is not None:
                    score[~access.mask(part.column(4))] = -np.inf
                top.add(part.column(0), score)
        yield from top.batches(names, key)

    columns = [key, "length", "phrase", "tf"] + ["users"] * restricted
    return coded.where("size(phrase) > 0").select(*columns).mapInArrow(best, f"query_id string, {key} {kind}, score double")
