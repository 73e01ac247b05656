"""Token sequences filled by best-two-fit.

Texts become pieces of at most one sequence; only longer texts are cut. How
pieces go together is planned on the number of pieces of each length, at most
one number per length, so the plan is as small for a trillion pieces as for a
thousand. A pattern of lengths is filled greedily; then its smallest member is
replaced by two others that fill the gap more tightly. A pattern is used as
often as the counts allow. Pieces of each length are numbered in blocks and
find their place in the plan by their number.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import numbered, small_batches
from cairn.session import durable

CAPACITY = 1024
END = 2
CACHE_WORDS = 100_000


#: How a byte-level vocabulary splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of Unicode, for RE2.
WHITE = r"[\t-\r \x1c-\x1f\x{85}\pZ]"
TANGLED = f"^ |{WHITE} | {WHITE}| $"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Ids of many texts by a byte-level vocabulary file, word by word.

    No token crosses the blank before a word unless other white space touches
    that blank. So texts are cut there, equal words of a batch are encoded once,
    and words met before are looked up while the cache holds them. Texts with
    tangled white space are encoded whole. Texts with the string of a special
    token are left to the tokenizers library, which knows what it stands for.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        self.path, self.limit, self.cache = path, limit, {}
        self.fast = self.full = None
        self.special: list[str] = []

    def _load(self) -> None:
        import tiktoken

        with open(self.path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        self.special = [x["content"] for x in stored.get("added_tokens", [])]
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in stored["model"]["vocab"].items() if token not in self.special
        }
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _word(self, word: str) -> bytes:
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) >= self.limit:
                self.cache.clear()
            ids = self.cache[word] = np.array(self.fast.encode_ordinary(" " + word), "<u4").tobytes()
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        if self.fast is None:
            self._load()
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, TANGLED)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = np.asarray(odd)
        plain = texts.filter(pa.array(~odd))
        words = pc.split_pattern(plain, " ")
        ends = words.offsets.to_numpy() - words.offsets[0].as_py() if len(words) else np.zeros(1, np.int64)
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy().astype(np.int64)
        heads = ends[:-1]
        coded_bytes = [self._word(w) for w in known]
        coded_bytes += [np.array(self.fast.encode_ordinary(known[i]), "<u4").tobytes() for i in index[heads].tolist()]
        index[heads] = len(known) + np.arange(len(heads))
        sizes = np.fromiter(map(len, coded_bytes), np.int64, len(coded_bytes)) // 4
        begins = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(coded_bytes), "<u4")
        each = sizes[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        flat = ids[np.repeat(begins[index] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = upto[ends]
        found, at = [], 0
        for n, whole in enumerate(odd):
            if whole:
                found.append(np.array(self._whole(texts[n].as_py()), "<u4"))
            else:
                found.append(flat[bounds[at]:bounds[at + 1]])
                at += 1
        return found


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document; what is over comes first."""
    first = length % capacity or capacity
    begin = 0
    while begin < length:
        size = first if begin == 0 else capacity
        yield begin, size
        begin += size


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, times: str | None = None,
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and the ids if asked for.

    A document is its text's ids and the end id; a null or empty text is the
    end id alone. Repeated rows give repeated pieces. If ``times`` names a
    column, a document is encoded once and its pieces stand that many times,
    with ``epoch`` from 0.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary), np.array([END], "<u4")
        for whole in batches:
            for batch in small_batches(whole, "text"):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for at, text in enumerate(encoder.encode(batch.column("text"))):
                    all_ids = np.concatenate([text, end])
                    for n, (begin, size) in enumerate(cut(len(all_ids), capacity)):
                        own = all_ids[begin:begin + size]
                        rows.append(at)
                        piece.append(n)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                made = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                if times:
                    made.append(batch.column(times).take(pa.array(rows, pa.int64())))
                yield pa.RecordBatch.from_arrays(made, [f.name for f in schema])

    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )
    if times is None:
        return docs.select("doc_id", "text").mapInArrow(run, schema)
    schema = schema.add("times", T.LongType())
    once = docs.select("doc_id", "text", F.col(times).cast("bigint").alias(times)).filter(F.col(times) > 0).mapInArrow(run, schema)
    return once.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1))).drop("times")


def _fill(left: np.ndarray, capacity: int) -> dict[int, int]:
    """One bin as {length: how many}: greedy, then best-two-fit."""
    used: dict[int, int] = {}
    there = np.flatnonzero(left)
    gap = capacity
    while gap > 0 and there.size:
        there = there[:np.searchsorted(there, gap, side="right")]
        if not there.size:
            break
        size = int(there[-1])
        take = min(gap // size, int(left[size]))
        used[size] = take
        gap -= take * size
        there = there[:-1]
    if gap == 0 or len(used) < 1:
        return used
    smallest = min(used)
    spare = left.copy()
    for size, n in used.items():
        spare[size] -= n
    room = gap + smallest
    spare = spare[:room + 1]
    index = np.arange(len(spare))
    at_most = np.maximum.accumulate(np.where(spare > 0, index, 0))  # largest length there is up to each
    big = np.flatnonzero(spare > 0)
    if not big.size:
        return used
    other = at_most[np.minimum(room - big, np.maximum(big - 1, 0))]
    twice = (spare[big] >= 2) & (2 * big <= room)
    total = np.where(other > 0, big + other, 0)
    double = np.where(twice, 2 * big, 0)
    best = int(np.argmax(np.maximum(total, double)))
    if max(total[best], double[best]) <= smallest:
        return used
    b = int(big[best])
    c = b if double[best] >= total[best] else int(other[best])
    used[smallest] -= 1
    if not used[smallest]:
        del used[smallest]
    for size in (b, c):
        used[size] = used.get(size, 0) + 1
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of each length go: rows of length, first rank, uses, first sequence, offset.

    The pieces of that length from ``first`` on go, ``uses`` to a sequence,
    into sequences ``sequence``, ``sequence`` + 1, ... at ``offset`` and after.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    done, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while left.any():
        used = _fill(left, capacity)
        times = min(int(left[s]) // n for s, n in used.items())
        offset = 0
        for size in sorted(used, reverse=True):
            rows.append((size, int(done[size]), used[size], sequence, offset))
            offset += size * used[size]
            done[size] += times * used[size]
            left[size] -= times * used[size]
        sequence += times
    table = pd.DataFrame(rows, columns=["length", "first", "uses", "sequence", "offset"])
    return table.sort_values(["length", "first"], ignore_index=True)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with sequence_id and offset, gapless from 0 in each sequence.

    ``parts`` must be a stored table. The driver sees one count per length.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    table = plan(counts, capacity)
    lengths, first = table["length"].to_numpy(), table["first"].to_numpy()
    uses, sequence, offset = (table[c].to_numpy() for c in ("uses", "sequence", "offset"))
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, number = length.to_numpy(), rank.to_numpy()
        at = np.zeros(len(size), np.int64)
        for one in np.unique(size):
            own = size == one
            low, high = starts[one], starts[one + 1]
            at[own] = low + np.searchsorted(first[low:high], number[own], side="right") - 1
        ahead = number - first[at]
        return pd.DataFrame({
            "sequence_id": sequence[at] + ahead // uses[at], "offset": offset[at] + ahead % uses[at] * size,
        })

    placed = F.pandas_udf(place, "sequence_id bigint, offset bigint")
    ranked = numbered(parts, ["length"], "rank").withColumn("_at", placed("length", "rank"))
    return ranked.select(*parts.columns, "_at.sequence_id", "_at.offset")


def packed(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, times: str | None = None,
) -> DataFrame:
    """All documents as placed pieces; see ``pieces`` and ``pack``. Other columns are not read."""
    return pack(durable(pieces(docs, vocabulary, capacity, with_ids, times), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The filled sequences: sequence_id, ids, and the spans of documents in them (needs ``ids``)."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return placed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id",
        F.flatten(F.col("m.ids")).alias("ids"),
        F.transform("m", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("spans"),
    )
