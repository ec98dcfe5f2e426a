"""Language-model scores by a probabilistic suffix tree over the tokens of a text, counted and kept as a distributed table.

The tree's symbols are all tokens, the end of a text and a mark before its start. A context of d symbols is a node if it occurs twice or more and its
next-symbol distribution diverges from that of its longest shorter context by more than it costs to write down: the gain in log likelihood exceeds
half the logarithm of the number of tokens read for each of its different next symbols. A node's distribution is smoothed towards the shorter context's, and a text is scored from the longest suffix of what was
read that the tree holds. No share of the corpus, no number of nodes and no vocabulary bounds the tree: it grows with what is read.

Documents are dealt into blocks, written once as codes of their tokens. Level by level a block sends the distinct (context, symbol) counts of its texts,
only after contexts that the level before has found twice, as packed arrays to the ranges of contexts that they belong to; a range adds up
what all blocks send, tests its contexts and sends each block the totals of what it asked for, held-out texts included. So counts meet in ranges of bounded size,
totals lie beside their block in the shared folder, and no table of rows is joined to the texts. A context whose count exceeds HOT is
dealt over several ranges by its next symbols; each range gives its part of the test.

Level 0 is the add-one unigram model; both models give one probability to every known token of a count and one to all unknown ones.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from contourflow.llm.common import fold, materialize, partitions, shared_path, utf8
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 3
END_TOKEN = b" "  # no word holds white space
START = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text in a block, and tokens whose counts a range takes, about.
BLOCK_BYTES = 6 << 20
RANGE_TOKENS, LEAST_RANGE_TOKENS = 1_250_000, 250_000
#: Occurrences from which a context is dealt over several ranges.
HOT = 1 << 20
#: Bits of a context's hash.
BITS = 48

BLOCKS = "block string, tokens long, ids array<string>, learn array<boolean>, lengths array<int>, hashes binary, codes binary"
SENT = "r int, block string, contexts binary, kinds binary, symbols binary, counts binary, sums binary, hot binary"
BACK = "r int, block string, counts binary, kinds binary, gains binary, total long, distinct long"


def pack(a: np.ndarray) -> bytes:
    """Compressed numbers, all first bytes before all second ones, since the higher ones are mostly zero."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending numbers by their steps, whose higher bytes are mostly zero."""
    return pack(np.diff(a, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mixed(a: np.ndarray | np.uint64, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit hashes, in their order."""
    x = b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= a
    x *= np.uint64(0x9E3779B185EBCA87)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    return x


def _sorted_by(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by context and symbol, equal pairs in any order; then both in that order. One sort of both in a word, then the few whose symbols differ above the bits that fit."""
    spare = np.uint64(64 - BITS)
    word = context << spare
    word |= symbol >> (np.uint32(32) - np.uint32(spare))
    order = np.argsort(word)
    w, s = word[order], symbol[order]
    changes = w[1:] != w[:-1]
    clash = np.flatnonzero((s[1:] != s[:-1]) & ~changes)
    if len(clash):
        starts = np.r_[0, np.flatnonzero(changes) + 1, len(w)]
        run = np.unique(np.searchsorted(starts, clash, side="right") - 1)
        length = starts[run + 1] - starts[run]
        some = np.repeat(starts[run] - np.cumsum(length) + length, length) + np.arange(length.sum())
        order[some] = order[some][np.lexsort((s[some], w[some]))]
        s[some] = symbol[order[some]]
    w >>= spare
    return order, w, s


@dataclass
class Layout:
    """What a block asks of a level: positions and each one's item, items sorted by (context, symbol) and each one's context, and the hot contexts' parts.

    hot_at: places in `at` of those after a hot context, hot_of: which one it is.
    """

    at: np.ndarray
    item: np.ndarray
    owner: np.ndarray
    contexts: np.ndarray
    kinds: np.ndarray
    symbols: np.ndarray
    hot: np.ndarray
    part_of: np.ndarray
    part_at: np.ndarray
    hot_at: np.ndarray
    hot_of: np.ndarray


class Block:
    """The texts of a block as one array of symbols, each text's after its start mark; positions are those of tokens and ends, hashes ascend."""

    def __init__(self, lengths: np.ndarray, learn: np.ndarray, hashes: np.ndarray, codes: np.ndarray) -> None:
        self.lengths, self.hashes, self.codes = lengths, hashes, codes
        self.firsts = np.cumsum(lengths) - lengths
        starts = self.firsts + np.arange(len(lengths))
        inside = np.ones(len(codes) + len(lengths), dtype=bool)
        inside[starts] = False
        self.symbols = np.empty(len(inside), dtype=np.uint64)
        self.symbols[starts] = START
        self.places = np.flatnonzero(inside)
        self.symbols[self.places] = hashes[codes]
        self.names = (mixed(hashes, np.ones(len(hashes), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.learn = np.repeat(learn, lengths)

    def before(self, counts: np.ndarray, start: float) -> np.ndarray:
        """For each position the count of the one before it in its text, for a text's first one that of its start."""
        out = np.empty(len(counts))
        out[1:] = counts[:-1]
        out[self.firsts] = start
        return out

    def layout(self, d: int, whole: np.ndarray, hot_from: int) -> Layout:
        """For contexts of d symbols; whole: how often the context before each position occurs, 0 where fewer symbols are before it."""
        at = np.flatnonzero(whole >= 2)
        places = self.places[at]
        context = np.uint64(d)
        for k in range(1, d + 1):
            context = mixed(context, self.symbols[places - k])
        symbol = self.names[self.codes[at]]
        often = whole[at]
        hot_at = np.flatnonzero(often > hot_from)
        parts = (-(-often[hot_at] // hot_from)).astype(np.int64)
        in_hot = context[hot_at]
        named = np.unique(in_hot)
        hot_of = np.searchsorted(named, in_hot)
        n_parts = np.zeros(len(named), dtype=np.int64)
        n_parts[hot_of] = parts
        part_of = np.repeat(np.arange(len(named)), n_parts)
        part = np.arange(len(part_of)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        shift = np.uint64(64 - BITS)
        part_names = mixed(named[part_of], (part + 2).astype(np.uint64)) >> shift
        context[hot_at] = mixed(in_hot, (symbol[hot_at] % parts + 2).astype(np.uint64))
        context >>= shift
        order, c, s = _sorted_by(context, symbol)
        new_context = np.ones(len(c), dtype=bool)
        np.not_equal(c[1:], c[:-1], out=new_context[1:])
        new_item = new_context.copy()
        new_item[1:] |= s[1:] != s[:-1]
        item = np.empty(len(at), dtype=np.int64)
        item[order] = np.cumsum(new_item) - 1
        contexts = own = c[new_context]
        owner = np.cumsum(new_context[new_item]) - 1
        # A block that holds a hot context asks all of its parts, those without a symbol of its own too.
        others = np.unique(part_names[own[np.minimum(np.searchsorted(own, part_names), len(own) - 1)] != part_names])
        if len(others):
            contexts = np.insert(own, np.searchsorted(own, others), others)
            owner = np.searchsorted(contexts, own)[owner]
        kinds = np.bincount(owner, minlength=len(contexts)).astype(np.uint32)
        part_at = np.searchsorted(contexts, part_names)
        hot = np.zeros(len(contexts), dtype=np.uint8)
        hot[part_at] = 1
        return Layout(at, item, owner, contexts, kinds, s[new_item], hot, part_of, part_at, hot_at, hot_of)

    def climb(self, totals: list[dict], hot_from: int) -> tuple[np.ndarray, np.ndarray]:
        """Each position's probability by the levels whose totals are given, and how often the context for the level after them occurs before it."""
        zero = totals[0]
        counts = zero["counts"].astype(np.float64)
        p = ((counts + 1) / (zero["total"] + zero["distinct"] + 1))[self.codes]
        whole = self.before(counts[self.codes], zero["ends"])
        for d, level in enumerate(totals[1:], 1):
            own = self.layout(d, whole, hot_from)
            often = whole[own.at]
            n = level["counts"].astype(np.float64)[own.item]
            kinds = level["kinds"].astype(np.float64)
            size = kinds[own.owner][own.item]
            if len(own.part_of):
                gains = np.zeros(len(own.contexts))
                gains[own.hot == 1] = level["gains"]
                n_hot = int(own.part_of.max()) + 1
                both = [np.bincount(own.part_of, weights=x[own.part_at], minlength=n_hot) for x in (gains, kinds)]
                most = often[own.hot_at]
                gain, size_hot = both[0][own.hot_of] - most * np.log(most), both[1][own.hot_of]
                size[own.hot_at] = np.where(gain > size_hot * cost_of_kind(zero["total"]), size_hot, 0)
            node = np.flatnonzero(size)
            at, size = own.at[node], size[node]
            p[at] = (n[node] + size * p[at]) / (often[node] + size)
            seen = np.zeros(len(whole))
            seen[own.at] = n
            whole = self.before(seen, 0)
        return p, whole


def cost_of_kind(total: float) -> float:
    """Nats that a next symbol of a node must gain: half the logarithm of the number of tokens."""
    return 0.5 * float(np.log(max(total, 1.0)))


def add_up(rows: pd.DataFrame, total_tokens: int) -> pd.DataFrame:
    """One range's totals for each block that asked: a level of contexts."""
    contexts = [unpack_sorted(x) for x in rows["contexts"]]
    kinds = [unpack(x, np.uint32).astype(np.int64) for x in rows["kinds"]]
    symbols = [np.frombuffer(bytes(x), dtype=np.uint32) for x in rows["symbols"]]
    hots = [unpack(x, np.uint8) == 1 for x in rows["hot"]]
    names, of = np.unique(np.concatenate(contexts), return_inverse=True)
    key = (np.repeat(of, np.concatenate(kinds)).astype(np.uint64) << np.uint64(32)) | np.concatenate(symbols)
    items, item_of = np.unique(key, return_inverse=True)
    n = np.bincount(item_of, weights=np.concatenate([unpack(x, np.uint32) for x in rows["counts"]]), minlength=len(items))
    owner = (items >> np.uint64(32)).astype(np.int64)
    total = lambda x, at: np.bincount(at, weights=x, minlength=len(names))
    whole, size = total(n, owner), total(n > 0, owner)
    gain = total(n * np.log(np.maximum(n, 1)), owner) - total(np.concatenate([np.frombuffer(bytes(x), dtype=np.float32) for x in rows["sums"]]), of)
    hot = np.zeros(len(names), dtype=bool)
    hot[of[np.concatenate(hots)]] = True
    node = (whole >= 2) & (gain - whole * np.log(np.maximum(whole, 1)) > size * cost_of_kind(total_tokens))
    size = np.where(hot | node, size, 0)
    out, a, b = [], 0, 0
    for r, block, c, s, h in zip(rows["r"], rows["block"], contexts, symbols, hots, strict=True):
        mine = of[a : a + len(c)]
        out.append((r, block, pack(n[item_of[b : b + len(s)]].astype(np.uint32)), pack(size[mine].astype(np.uint32)), gain[mine[h]].tobytes(), 0, 0))
        a, b = a + len(c), b + len(s)
    return pd.DataFrame(out, columns=[c.split()[0] for c in BACK.split(", ")])


def add_up_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """One range's totals of tokens for each block, with how many tokens it has in all and how many different ones."""
    tokens = [unpack_sorted(x) for x in rows["contexts"]]
    names, of = np.unique(np.concatenate(tokens), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([unpack(x, np.uint32) for x in rows["counts"]]), minlength=len(names))
    out, a = [], 0
    for r, block, t in zip(rows["r"], rows["block"], tokens, strict=True):
        out.append((r, block, pack(n[of[a : a + len(t)]].astype(np.uint64)), b"", b"", int(n.sum()), int((n > 0).sum())))
        a += len(t)
    return pd.DataFrame(out, columns=[c.split()[0] for c in BACK.split(", ")])


def _save(where: pafs.FileSystem, path: str, arrays: dict[str, np.ndarray]) -> int:
    """Write arrays under a temporary name and rename; a task that runs again replaces the file by its equal."""
    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with where.open_output_stream(temporary, compression=None) as out:
        for a in arrays.values():
            data = pack(a)
            out.write(len(data).to_bytes(8, "little") + data)
            size += len(data) + 8
    where.move(temporary, path)
    return size


def _load(where: pafs.FileSystem, path: str, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    with where.open_input_stream(path, compression=None) as source:
        return {name: unpack(source.read(int.from_bytes(source.read(8), "little")), kind) for name, kind in kinds.items()}


LEVEL = {"counts": np.uint32, "kinds": np.uint32, "gains": np.float64}
TOKENS = {"counts": np.uint64, "totals": np.int64}


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held_out_of: int, held_out: int, block_bytes: int) -> DataFrame:
    """Rows of BLOCKS: the documents of a partition in turn, a block as soon as it has block_bytes."""
    learn = F.col(id_col).isNotNull() & (fold(F.col(id_col), held_out_of) != held_out)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), utf8(text_col).alias("data"), learn.alias("learn"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        ids, learned, lengths, codes, size = [], [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal made, ids, learned, lengths, codes, size
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, code), dtype=np.uint64, count=len(code))
            order = np.argsort(hashes)
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            row = (f"{task:06d}-{made:06d}", sum(lengths), ids, learned, lengths, hashes[order].tobytes(), pack(place[np.concatenate(codes)]))
            made, ids, learned, lengths, codes, size = made + 1, [], [], [], [], 0
            code.clear()
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for pdf in batches:
            for i, data, known in zip(pdf["id"], pdf["data"], pdf["learn"].tolist(), strict=True):
                tokens = data.lower().split()
                tokens.append(END_TOKEN)
                codes.append(np.fromiter(map(code.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                ids.append(i)
                learned.append(known)
                lengths.append(len(tokens))
                size += len(data) + 16
                if size >= block_bytes:
                    yield close()
        if ids:
            yield close()

    return rows.mapInPandas(run, BLOCKS)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 7, held_out: int = 2, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, hot_from: int = HOT) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Texts whose id's crc32 mod held_out_of is held_out are not learned from, nor are those with a null id. Tokens are the words between runs of
    white space after lower-casing A-Z, then one end. score is the tree's log10 probability of the text, base_score the add-one unigram
    model's. Null and empty texts have the end alone. Repeated rows all stay and all count. With nothing to learn from, every token is
    unknown and has probability 1. A text is in one block, so a very long one makes a block of its size, some 150 bytes of memory a token. Equal gain and
    size is no divergence. Contexts and next symbols are known by hashes of 48 and 32 bits, tokens by 64. Other columns are not looked at.
    """
    spark = docs.sparkSession
    blocks = materialize(blocks_of(docs, id_col, text_col, held_out_of, held_out, block_bytes), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    n_ranges = max(1, -(-tokens // RANGE_TOKENS), min(partitions(spark), -(-tokens // LEAST_RANGE_TOKENS)))
    folder = shared_path(spark, "totals")
    cuts = [np.array([-(-(k << bits) // n_ranges) for k in range(1, n_ranges)], dtype=np.uint64) for bits in (64, BITS)]

    def opened(row: tuple, level: int) -> tuple[Block, list[dict]]:
        """A block and the totals of the levels under `level`."""
        block = Block(np.asarray(row.lengths, dtype=np.int64), np.asarray(row.learn, dtype=bool), np.frombuffer(bytes(row.hashes), dtype=np.uint64), unpack(row.codes, np.int32))
        where, path = pafs.FileSystem.from_uri(_uri(folder))
        totals = [_load(where, f"{path}/{d}-{row.block}", LEVEL if d else TOKENS) for d in range(level)]
        if totals:
            zero = totals[0]
            end = np.searchsorted(block.hashes, np.uint64(xxhash.xxh64_intdigest(END_TOKEN)))
            zero |= {"total": int(zero["totals"][0]), "distinct": int(zero["totals"][1]), "ends": int(zero["counts"][end])}
        return block, totals

    def send(level: int):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    block, totals = opened(row, level)
                    if level:
                        p, whole = block.climb(totals, hot_from)
                        own = block.layout(level, whole, hot_from)
                        known = block.learn[own.at]
                        counts = np.bincount(own.item[known], minlength=len(own.symbols)).astype(np.uint32)
                        sums = np.bincount(own.owner[own.item[known]], weights=np.log(p[own.at[known]]), minlength=len(own.contexts))
                        names, kinds, hot = own.contexts, own.kinds, own.hot
                        begins = np.r_[0, np.cumsum(kinds, dtype=np.int64)]
                    else:
                        names, counts = block.hashes, np.bincount(block.codes[block.learn], minlength=len(block.hashes)).astype(np.uint32)
                    edges = np.r_[0, np.searchsorted(names, cuts[1 if level else 0]), len(names)]
                    out = []
                    for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        if not level:
                            out.append((r, row.block, pack_sorted(names[a:b]), b"", b"", pack(counts[a:b]), b"", b""))
                        elif a < b:
                            x, y = begins[a], begins[b]
                            out.append((r, row.block, pack_sorted(names[a:b]), pack(kinds[a:b]), own.symbols[x:y].tobytes(), pack(counts[x:y]), sums[a:b].astype(np.float32).tobytes(), pack(hot[a:b])))
                    if out:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

        return run

    def save(level: int):  # noqa: ANN202
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("r")
            where, path = pafs.FileSystem.from_uri(_uri(folder))
            where.create_dir(path, recursive=True)
            joined = lambda name, kind: np.concatenate([unpack(x, kind) for x in rows[name]])
            if level:
                arrays = {"counts": joined("counts", np.uint32), "kinds": joined("kinds", np.uint32), "gains": np.concatenate([np.frombuffer(bytes(x), dtype=np.float64) for x in rows["gains"]])}
            else:
                arrays = {"counts": joined("counts", np.uint64), "totals": np.array([rows["total"].sum(), rows["distinct"].sum()], dtype=np.int64)}
            return pd.DataFrame({"block": [key[0]], "total": [int(rows["total"].sum())], "bytes": [_save(where, f"{path}/{level}-{key[0]}", arrays)]})

        return run

    def save_nothing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Empty totals for blocks that ask nothing of a level."""
        where, path = pafs.FileSystem.from_uri(_uri(folder))
        for pdf in batches:
            for block in pdf["block"]:
                _save(where, f"{path}/{block}", {k: np.zeros(0, dtype=t) for k, t in LEVEL.items()})
            yield pd.DataFrame({"n": [len(pdf)]})

    def adder(total: int):  # noqa: ANN202
        return lambda rows: add_up(rows, total)

    learned = 0
    for level in range(depth + 1):
        asked = blocks.mapInPandas(send(level), SENT)
        totals = asked.groupBy("r").applyInPandas(adder(learned) if level else add_up_tokens, BACK)
        written = totals.groupBy("block").applyInPandas(save(level), "block string, total long, bytes long")
        done = materialize(written, "written")
        if not level:
            learned = done.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
        else:
            rest = blocks.select("block").join(done.select("block"), "block", "left_anti").select(F.concat(F.lit(f"{level}-"), "block").alias("block"))
            rest.mapInPandas(save_nothing, "n long").agg(F.sum("n")).first()
        del asked, totals, written
        spark.sparkContext._jvm.System.gc()  # the level's shuffles are of no more use; the driver's cleaner drops them once they are unreachable

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                block, totals = opened(row, depth + 1)
                zero = totals[0]
                p, _ = block.climb(totals, hot_from)
                counts = zero["counts"][block.codes].astype(np.float64)
                begins = np.cumsum(block.lengths) - block.lengths
                of_text = lambda x: np.add.reduceat(x, begins)  # noqa: E731,B023
                base = np.log10((counts + 1) / (zero["total"] + zero["distinct"] + 1))
                yield pd.DataFrame({
                    "id": row.ids, "n_tokens": block.lengths, "n_known": of_text((counts > 0).astype(np.int64)), "train_tokens": zero["total"],
                    "base_score": of_text(base), "score": of_text(np.log10(p)),
                })

    scored = blocks.mapInPandas(run, "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    scored = scored.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % held_out_of == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _uri(path: str) -> str:
    """The path as pyarrow wants it: file:/x is file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
