"""Token ids in files of Re-Pair grammars, with random access.

Documents are sorted by id over all shards. A shard's task encodes its texts with the tokenizers library, ends each
document with an id, and packs the ids in blocks of about BLOCK ids (what a reader has to hold for random access). Of a
block, frequent pairs of neighbouring symbols are replaced by nonterminals until no pair occurs LEAST times; no pair
reaches over a document's end. A round takes all frequent pairs that win their bucket of a hash table (another salt in
each round; the last rounds count exactly) and replaces their occurrences from left to right. What is stored: the rules,
each symbol's expansion length, each document's first symbol and first token, and the symbols; so any token is found by
document, then by sums of lengths.

Files are written whole under a temporary name and then renamed, so that a repeated task replaces its file by an
equal one.

Defined cases: a null text counts as empty (only the end id is stored); a null document id comes first; documents
with equal ids are ordered by a hash of the text; repeated rows are stored each; the id -2^63 is taken for null; other
columns are ignored; an empty table gives no shards and no rows. A text of any length is encoded whole; one of more than
BLOCK ids is a block of its own, so a task has to hold its ids some ten times over.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bytewords as W
from quillgraph.llm.common import pieces, put_in_place, shared_dir, small_batches, utf8

BLOCK, LEAST = 1 << 20, 20
MAGIC = b"QGRP0001"
NO_ID = -(1 << 63)
#: slots and ids of each worker's table of words
SLOTS, MOST = 1 << 20, 1 << 23


def pack(ids: np.ndarray, last: np.ndarray, least: int = LEAST, base: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs of symbols; rule i is symbol base + i) and a mask of the symbols that end documents.

    No pair of neighbours within a document is left that occurs least times without overlaps.
    """
    sym, last, rules, known, r, sure = ids.astype(np.int32), last.copy(), [], 0, 0, False
    bits = 18
    # places whose pair may be frequent: counts only fall, so a pair that was rare once is out unless a symbol is new
    open_ = np.ones(len(sym), bool)
    open_[-1:] = False
    open_ &= ~last
    while True:
        at = np.flatnonzero(open_)
        if not len(at):
            break
        key = (sym[at].astype(np.int64) << 32) | sym[at + 1]
        if sure or len(at) < 5000:  # few places are left: count exactly
            values, slot = np.unique(key, return_inverse=True)
        else:
            slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + (r << 1))) >> np.uint64(64 - bits)).view(np.int64)
            values = np.zeros(1 << bits, np.int64)
            values[slot] = key
            won = values[slot] == key
            at, slot = at[won], slot[won]
        r += 1
        # of a run of places of one pair (as in "aaaa") every second one, from its start, is taken
        once = every_second(at, slot)
        frequent = np.bincount(slot[once], minlength=len(values)) >= least
        hit = frequent[slot]
        open_[at[~hit]] = False
        chosen = np.flatnonzero(frequent)
        if not len(chosen):
            sure = True
            continue
        rule = np.full(len(values), -1, np.int32)
        rule[chosen] = np.arange(len(chosen), dtype=np.int32)
        take = once & hit
        at, new = at[take], rule[slot[take]]
        # chosen pairs that overlap: from each stretch's start every second one is replaced, a later round sees the rest
        odd = every_second(at)
        at, new = at[odd], new[odd]
        used = np.bincount(new, minlength=len(chosen)) > 0
        number = (np.cumsum(used) - 1 + known).astype(np.int32)
        rules.append(np.stack([values[chosen[used]] >> 32, values[chosen[used]] & 0xFFFFFFFF], 1).astype(np.int32))
        sym[at] = number[new] + base
        known += int(used.sum())
        last[at] = last[at + 1]
        open_[at] = True
        open_[at[at > 0] - 1] = True
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        # a place before a dropped one now has the one after that as its neighbour
        sym, last, open_ = sym[stay], last[stay], open_[stay]
        open_[-1:] = False
        open_ &= ~last
    return sym, (np.concatenate(rules) if rules else np.zeros((0, 2), np.int32)), last


def every_second(at: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Of stretches of neighbouring places (of one kind) the first, third, fifth ... place."""
    begin = np.ones(len(at), bool)
    begin[1:] = at[1:] != at[:-1] + 1
    if kind is not None:
        begin[1:] |= kind[1:] != kind[:-1]
    run = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
    return (np.arange(len(at)) - run) & 1 == 0


def expansions(rules: np.ndarray, base: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rules' expansions, one after another, with starts and lengths."""
    size = np.zeros(len(rules), np.int64)
    parts: list[np.ndarray] = []
    for i, (a, b) in enumerate(rules.tolist()):
        x = [parts[s - base] if s >= base else np.array([s], np.int32) for s in (a, b)]
        parts.append(np.concatenate(x))
        size[i] = len(parts[-1])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.cumsum(size) - size, size


def block_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of whole documents."""
    ends = np.cumsum(counts)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    sym, rules, last = pack(ids, last)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    base = 1 << 20
    size = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[i] = (size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1)
    # terminals keep their numbers, nonterminals follow the largest of them
    top = int(ids.max()) + 1
    wide = "<u2" if top + len(rules) <= 1 << 16 else "<u4"
    near = lambda x: np.where(x >= base, x - base + top, x)
    arrays = [doc_ids.astype("<i8"), (ends - counts).astype("<i8"), first.astype("<i8"), near(rules).astype("<u4"), size.astype("<u4"), near(sym).astype(wide)]
    head = json.dumps({"top": top, "docs": len(doc_ids), "tokens": len(ids), "rules": len(rules), "symbols": len(sym), "wide": wide}).encode()
    return b"".join([struct.pack("<I", len(head)), head, *(x.tobytes() for x in arrays)])


class Block:
    """A block as read; tokens(i) gives one document's ids and tokens(i, a, b) a part of them."""

    def __init__(self, raw: memoryview):
        n = struct.unpack_from("<I", raw)[0]
        h = json.loads(bytes(raw[4 : 4 + n]))
        at = 4 + n

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        self.head, self.doc_ids, self.first_token, self.first = h, take("<i8", h["docs"]), take("<i8", h["docs"]), take("<i8", h["docs"])
        self.rules, self.size, self.sym = take("<u4", 2 * h["rules"]).reshape(-1, 2), take("<u4", h["rules"]), take(h["wide"], h["symbols"])
        self.flat, self.start, _ = expansions(self.rules.astype(np.int32), h["top"])
        self.all_size = np.concatenate([np.ones(h["top"], np.int32), self.size.astype(np.int32)])
        self.all_start = np.concatenate([np.arange(h["top"], dtype=np.int32), (h["top"] + self.start).astype(np.int32)])
        self.all_flat = np.concatenate([np.arange(h["top"], dtype=np.int32), self.flat])

    def ends(self, i: int) -> int:
        return int(self.first[i + 1]) if i + 1 < len(self.first) else len(self.sym)

    def all_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and each document's number of ids."""
        n = self.all_size[self.sym]
        ends = np.cumsum(n)
        ids = self.all_flat[np.repeat(self.all_start[self.sym] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.append(self.first_token, len(ids)))

    def tokens(self, i: int, a: int = 0, b: int | None = None) -> np.ndarray:
        sym = self.sym[self.first[i] : self.ends(i)].astype(np.int64)
        n = self.all_size[sym]
        ends = np.cumsum(n)
        x, y = 0, len(sym)
        if a or b is not None:
            x = int(np.searchsorted(ends, a, side="right"))
            y = len(sym) if b is None else min(len(sym), int(np.searchsorted(ends, b)) + 1)
            a -= int(ends[x - 1]) if x else 0
            b = None if b is None else b - (int(ends[x - 1]) if x else 0)
            sym, n = sym[x:y], n[x:y]
            ends = np.cumsum(n)
        out = self.all_flat[np.repeat(self.all_start[sym] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return out[a:b]


#: letters that stand for bytes over 127 in vocabularies of byte-level BPE
BYTE_LETTERS = {b: c for b, c in zip([*range(0x80, 0xA1), 0xAD], range(0x122, 0x144))}
LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])

#: parts of a tokenizer file of which the table of words knows that they work word by word
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
SIGN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class WordTable:
    """The ids of words met so far, by the words' 64-bit hashes: a direct-mapped table and one array of ids.

    The tokenizer's pretokens never reach over ASCII white space, nor from a Latin letter to the signs that end a
    word, and it lower-cases; so the library encodes each word once as long as the table holds it. That holds for files
    with the normaliser and the pretokenizer in WORDWISE; texts of any other file go to the library whole. With added,
    the vocabulary's added tokens are found in texts, as the library does by default: words that hold one stay whole.
    """

    def __init__(self, path: str, added: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.wordwise = all(parts.get(k) == v for k, v in WORDWISE.items()) and not any(x[k] for x in parts.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        top = max(self.full.get_vocab().values(), default=0)
        self.kind = np.uint16 if top < 1 << 16 else np.uint32
        self.full.encode_special_tokens = not added
        marks = [re.escape(x.content.encode()) for x in self.full.get_added_tokens_decoder().values()] if added else []
        self.marks = re.compile(b"|".join(marks)) if marks else None
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.reset()

    def reset(self) -> None:
        self.keys, self.start, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 20, self.kind), 0

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by end_id, and their numbers."""
        if not self.wordwise:
            text = raw.tobytes()
            got = [e.ids + [end_id] for e in self.full.encode_batch_fast([text[a:b].decode() for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)]
            return np.array([y for x in got for y in x], np.uint32), np.array([len(x) for x in got])
        starts, ends, woff = W.find_words(raw, off)
        cut = tails(raw, starts, ends)
        held = [m.start() for m in self.marks.finditer(raw.tobytes())] if self.marks else []
        marked = np.unique(np.searchsorted(starts, held, side="right") - 1) if held else np.zeros(0, np.int64)
        cut[marked] = 0
        tail = (cut > 0).astype(np.int64)
        each = np.repeat(np.arange(len(starts)), 1 + tail)
        shift = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(1 + tail, out=shift[1:])
        second = np.ones(len(each), bool)
        second[shift[:-1]] = False
        begin, stop = np.where(second, ends[each] - cut[each], starts[each]), np.where(second, ends[each], ends[each] - cut[each])
        h = W.hash_words(raw, begin, stop)
        for i in marked.tolist():  # added tokens are found in their own case only, which hash_words doesn't see
            h[shift[i]] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        place, size = self.start[slot], self.size[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            text = raw.tobytes()
            fresh, where, n = self.ids_of([text[x:y].decode() for x, y in zip(begin[at].tolist(), stop[at].tolist())])
            if self.used + len(fresh) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(fresh)), self.kind)])
            self.flat[self.used : self.used + len(fresh)] = fresh
            where += self.used
            self.used += len(fresh)
            place[miss], size[miss] = where[back], n[back]
            s = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[s], self.start[s], self.size[s] = new, where, n
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        bounds = total[shift[woff]]
        counts = np.diff(bounds) + 1
        ids = self.flat[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
        out = np.insert(ids, bounds[1:], end_id)
        if self.used > MOST:
            self.reset()
        return out, counts

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in some order, and each word's place among them and number of ids."""
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            kinds[2 if not w.isalpha() else 0 if w.isascii() else 1 if max(w) < "\u0250" and "\u0130" not in w else 2].append(i)
        flat, where, size, at = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for kind, own in enumerate(kinds):
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                if kind < 2:  # words of Latin letters need the library's merges only, not its normaliser
                    text = " ".join([words[i] for i in part]).lower()
                    if kind:
                        text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
                    found = self.bare.encode(text, add_special_tokens=False)
                    ids, word = np.array(found.ids, self.kind), np.array(found.word_ids)
                    n = np.bincount(word, minlength=len(part))
                else:
                    got = [e.ids for e in self.full.encode_batch_fast([words[i] for i in part], add_special_tokens=False)]
                    n = np.array([len(x) for x in got])
                    ids = np.array([y for x in got for y in x], self.kind)
                size[part], where[part] = n, at + np.cumsum(n) - n
                at += len(ids)
                flat.append(ids)
        return np.concatenate(flat), where, size


def tails(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 8) -> np.ndarray:
    """Of each word, the length of the ASCII signs that end it, if a Latin letter stands before them, else 0."""
    out = np.zeros(len(starts), np.int64)
    at = np.flatnonzero((ends - starts > 1) & SIGN[raw[ends - 1]])
    for k in range(1, most + 1):
        at = at[ends[at] - k > starts[at]]
        before = raw[ends[at] - k - 1]
        wide = (ends[at] - k - 2 >= starts[at]) & (before >= 0x80)
        lead = raw[np.maximum(ends[at] - k - 2, 0)]
        letter = LETTER[before] | (wide & (lead == 0xC3) & (before != 0x97) & (before != 0xB7))
        out[at[letter]] = k
        at = at[SIGN[before]]
    return out


_TABLES: dict[tuple[str, bool], WordTable] = {}


def word_table(path: str, added: bool = True) -> WordTable:
    if (path, added) not in _TABLES:
        _TABLES[path, added] = WordTable(path, added)
    return _TABLES[path, added]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, added: bool = True) -> list[dict]:
    """Writes a file per range of ids into folder (a URI that all executors reach); gives shard, path, docs, tokens.

    What comes back is a row per file, whose number is the number of shuffle partitions. Added tokens inside a text get
    their own ids; without added they are text like any other.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, temp = f"{root}/{shard:08d}.qgrp", f"{root}/_{shard:08d}-{TaskContext.get().taskAttemptId()}"
        out, places, docs_n, tokens_n = None, [], 0, 0
        ids, parts, held = [], [], 0
        table = word_table(tokenizer, added)

        def flush():
            nonlocal ids, parts, held, docs_n, tokens_n
            if parts:
                places.append(out.tell())
                out.write(block_bytes(np.array(ids, np.int64), np.array([len(p) for p in parts]), np.concatenate(parts)))
                docs_n, tokens_n = docs_n + len(parts), tokens_n + held
                ids, parts, held = [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(temp)
                out.write(MAGIC)
            keys, (raw, off) = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in pieces(off):
                got, n = table.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                at = 0
                for key, c in zip(keys[a:b], n.tolist()):
                    ids.append(NO_ID if key is None else key)
                    parts.append(got[at : at + c])
                    at += c
                    held += c
                    if held >= BLOCK:
                        flush()
        if out is None:
            return
        flush()
        foot = json.dumps({"blocks": places, "docs": docs_n, "tokens": tokens_n}).encode()
        out.write(foot + struct.pack("<I", len(foot)))
        out.close()
        put_in_place(fs, temp, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "docs": [docs_n], "tokens": [tokens_n]})

    small_batches(docs.sparkSession, 2000)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    ranged = rows.repartitionByRange(F.col("i").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("i").asc_nulls_first(), F.xxhash64("t"))
    found = ranged.mapInArrow(write, "shard long, path string, docs long, tokens long").collect()
    return sorted((r.asDict() for r in found), key=lambda r: r["shard"])


def blocks(folder: str, path: str) -> Iterator[Block]:
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(path) as f:
        size = f.size()
        n = struct.unpack("<I", f.read_at(4, size - 4))[0]
        foot = json.loads(f.read_at(n, size - 4 - n))
        for a, b in zip(foot["blocks"], [*foot["blocks"][1:], size - 4 - n]):
            yield Block(memoryview(f.read_at(b - a, a)))


def read_shards(spark: SparkSession, folder: str, shards: list[dict], digest: bool = True) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32, or the ids themselves."""
    base, at = [], 0
    for s in shards:
        base.append((s["shard"], s["path"], at))
        at += s["tokens"]
    kind = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["base"]
                for block in blocks(folder, row["path"]):
                    flat, n = block.all_tokens()
                    ids = np.split(flat.astype("<u4"), np.cumsum(n)[:-1])
                    start = at + np.cumsum(n) - n
                    at += int(n.sum())
                    last = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.doc_ids == NO_ID), pa.array(start), pa.array(n), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    rows = spark.createDataFrame(base, "shard long, path string, base long")
    return rows.repartition(max(1, len(base)), "shard").mapInArrow(read, kind)


def store_tokens(docs: DataFrame, tokenizer: str, **kinds) -> tuple[str, list[dict]]:
    folder = shared_dir(docs.sparkSession, "tokens")
    return folder, write_shards(docs, tokenizer, folder, **kinds)
