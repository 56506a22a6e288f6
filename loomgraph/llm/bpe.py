"""Byte-level BPE with content-defined chunk reuse.

Texts are cut where a rolling hash says so, and the chunks of equal texts count once. Chunks that occur more than once are
found by their digests (128 bits of BLAKE2b), at any number of chunks by joins, and one occurrence of each is
encoded, once for all documents. Texts without a shared chunk are encoded whole. In the others the ids of
shared chunks and of the runs between them are put together, and each join is repaired: a window of a few tokens on both
sides is encoded again, and doubled until it agrees with the ids outside (`Engine.join` says what is asked), so a
join costs a few windows whatever the script and the length of the words.

The engine is built from the vocabulary file. Texts of the usual scripts go through a fast
implementation of the same byte-pair ranks; texts with other characters, where Unicode tables of the two
libraries might differ, go through the tokenizers library itself. A file whose normaliser, splitting or model is not the
byte-level one that these ranks and joins are made for is used through the library alone, text by text.

Defined results: a null text is empty and has no tokens; special tokens in a text are encoded as such,
as the tokenizers library does; a text of any length is taken whole (one text and its ids must fit in a task);
of equal chunks the first by text digest is encoded; repeated rows and null ids each keep their own result; an
empty table gives an empty result; only the id and text columns are read, so no further one can clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrays import slices
from loomgraph.llm.cdc import cuts
from loomgraph.llm.skew import join_counted
from loomgraph.session import materialise, table

#: The uses of a chunk that meet its ids in one task; a chunk of more uses is dealt to several, with a copy of its ids in each.
USES_A_PART = 1_000

#: Tokens on each side of a join that are encoded again at first, and bytes that are, at least.
WINDOW, REACH = 8, 32
#: What a vocabulary file must say for ranks and joins; another one goes to the library as a whole.
_PLAIN = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}

_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏΑ-Ωα-ωА-я‐-‧‰-⁞€]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Engine:
    """Encode and decode with the vocabulary of a byte-level BPE tokenizer file."""

    _held: dict[str, Engine] = {}

    @classmethod
    def of(cls, path: str) -> Engine:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.local = self._is_plain(spec)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special, self.special_ids = set(special), set(special.values())
        self.reach = max([REACH, *(len(x.encode()) for x in special)])
        size = max([*spec["model"]["vocab"].values(), *special.values()]) + 1
        self.names = [str(i) for i in range(size)]
        self.width = np.uint16 if size <= 65536 else np.uint32
        self.fast = None
        if not self.local:
            return
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        merged = [a + b for a, b in ((x.split(" ") if isinstance(x, str) else x) for x in spec["model"]["merges"])]
        by_rank = [spec["model"]["vocab"][x] for x in merged]
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        if by_rank == sorted(by_rank):
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = [b""] * size
        for k, v in (*ranks.items(), *((k.encode(), v) for k, v in special.items())):
            self.bytes[v] = k

    @staticmethod
    def _is_plain(spec: dict) -> bool:
        """Whether the file is a byte-level BPE with the usual splitting, as pattern and joins suppose."""
        split, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and decoder.get("type") == "ByteLevel"
        model = all((spec["model"].get(k) or v) == v for k, v in _PLAIN.items())
        added = not any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        return bool(byte_level and model and added and spec.get("normalizer") is None and spec.get("post_processor") is None)

    @cached_property
    def exact(self):
        """The library's own tokenizer, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _OTHER.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.special)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def unpack(self, packed: bytes) -> list[int]:
        return np.frombuffer(packed, self.width).tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        if not self.local:
            return self.exact.decode(list(ids), skip_special_tokens=False)
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _sides(self, ids: list[int], at: int) -> str:
        """How the text can be cut before token `at` (between two tokens): "word" where a word or number ends in every
        context, "run" inside a run of letters, numbers, signs or blanks, "" nowhere known."""
        around = ids[max(0, at - 12) : at + 4]
        if not self.special_ids.isdisjoint(around) or self.bytes[ids[at]][0] & 0xC0 == 0x80:
            return ""
        before = self.decode_bytes(ids[max(0, at - 12) : at]).decode("utf-8", "ignore")[-3:]
        after = self.decode_bytes(ids[at : at + 4]).decode("utf-8", "ignore")[:2]
        if not before or not after:
            return ""
        last, follow = _kind(before[-1]), _kind(after[0])
        if follow == "Z" != last and last or last in ("L", "N") and follow in ("L", "N", "P") and last != follow:
            return "word"
        if last != follow or last == "?":
            return ""
        # an apostrophe takes up to two letters from the run after it, so three letters must stand before the cut; a
        # cut before an apostrophe would make it one that takes letters; the last blank of a run may belong to a word
        inside = {"L": len(before) == 3 and all(_kind(c) == "L" for c in before), "N": True, "P": after[0] != "'", "Z": len(after) == 2 and _kind(after[1]) == "Z"}
        return "run" if last and inside[last] else ""

    def _cut(self, ids: list[int], at: int, step: int) -> tuple[int, str]:
        """The nearest place from `at` on, in this direction, where the text can be cut; the end of the ids is one."""
        while 0 < at < len(ids):
            if kind := self._sides(ids, at):
                return at, kind
            at += step
        return max(0, min(at, len(ids))), "end"

    def _window(self, ids: list[int], tokens: int, step: int) -> int:
        """The place `tokens` tokens, and no fewer than `reach` bytes, from the end (step -1) or the start (1)."""
        at, size = (len(ids), 0) if step < 0 else (0, 0)
        while 0 <= at + min(step, 0) < len(ids) and (tokens > 0 or size < self.reach):
            size += len(self.bytes[ids[at + min(step, 0)]])
            at, tokens = at + step, tokens - 1
        return at

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two texts one after the other, from their encodings; left is changed.

        A window around the join is encoded again. Its cuts lie where a word or number ends in every context, so that the
        text is split alike on both sides, or inside a run of one kind of characters. There the window's outermost token must equal the token
        that was there before: then all neighbouring tokens of the run have been neighbours in an encoding, and such a sequence is the
        encoding of its bytes. While that doesn't hold the window is doubled, so the work is a few times the last window.
        """
        if not left or not right:
            left.extend(right)
            return left
        w, v = WINDOW, WINDOW
        while True:
            i, a = self._cut(left, self._window(left, w, -1), -1)
            j, b = self._cut(right, self._window(right, v, 1), 1)
            middle = self.encode((self.decode_bytes(left[i:]) + self.decode_bytes(right[:j])).decode("utf-8"))
            good_left, good_right = a != "run" or middle[0] == left[i], b != "run" or middle[-1] == right[j - 1]
            if good_left and good_right:
                del left[i:]
                left.extend(middle)
                left.extend(right[j:])
                return left
            w, v = (w if good_left else 2 * w), (v if good_right else 2 * v)

    def summary(self, ids) -> tuple[int, bytes, bytes]:
        """Token count, SHA-256 of the ids joined by commas, and SHA-256 of the decoded text."""
        return len(ids), hashlib.sha256(",".join(map(self.names.__getitem__, ids)).encode()).digest(), hashlib.sha256(self.decode(ids).encode()).digest()


def _kind(c: str) -> str:
    """L, N, P (a sign) or Z (a blank) where all Unicode tables since 3.2 agree, "?" for what is at least no blank, else empty."""
    if c in " \t\n\r":
        return "Z"
    now, then = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)
    if now in "ZC":
        return ""
    if now in "LN":
        return now if then[0] == now else "?"
    return "P" if then[0] in "PSM" or then == "Cn" else "?"


def _chunks(buf: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text, moved on to the next start of a character."""
    out = []
    for i, ends in enumerate(cuts(buf, off)):
        base, n, got = int(off[i]), int(off[i + 1] - off[i]), []
        for end in ends.tolist():
            while end < n and buf[base + end] & 0xC0 == 0x80:
                end += 1
            if not got or end > got[-1]:
                got.append(end)
        out.append(got)
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in slices(batch, "text"):
            text, start, stop, digests = [], [], [], []
            for i, ends in enumerate(_chunks(buf, off)):
                view, at = memoryview(np.ascontiguousarray(buf[off[i] : off[i + 1]])), 0
                for end in ends:
                    digests.append(hashlib.blake2b(view[at:end], digest_size=16).digest())
                    text.append(i)
                    start.append(at)
                    stop.append(end)
                    at = end
            if text:
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [rows.column("th").take(pa.array(text)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["th", "start", "stop", "hi", "lo"])


_PART = "th binary, seg int, hi long, lo long, part int, ids binary, n_tokens long, ids_sha binary, text_sha binary"
_TYPES = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _PART.split(", ")]


def _encoder(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine.of(path)
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                # th with seg null: a whole result; th and seg: part of a text, a use of a chunk with the part it
                # is dealt to; th null: a shared chunk with its number of parts
                out: list[tuple] = []
                for i, (th, uses) in enumerate(zip(rows.column("th").to_pylist(), rows.column("uses").to_pylist(), strict=True)):
                    text = buf[off[i] : off[i + 1]].tobytes()
                    packed = lambda a, b, text=text: engine.pack(engine.encode(text[a:b].decode("utf-8")))
                    if not uses:
                        ids = engine.encode(text.decode("utf-8"))
                        out.append((th, None, None, None, None, engine.pack(ids) if with_ids else None, *engine.summary(ids)))
                        continue
                    begun = 0
                    for x in sorted(uses, key=lambda x: x["start"]):
                        if begun < x["start"]:
                            out.append((th, begun, None, None, None, packed(begun, x["start"]), None, None, None))
                        out.append((th, x["start"], x["hi"], x["lo"], x["part"], None, None, None, None))
                        if x["own"]:
                            out.append((None, None, x["hi"], x["lo"], x["parts"], packed(x["start"], x["stop"]), None, None, None))
                        begun = x["stop"]
                    if begun < len(text):
                        out.append((th, begun, None, None, None, packed(begun, len(text)), None, None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return run


_BUILT = "th binary, ids binary, n_tokens long, ids_sha binary, text_sha binary"


def _assembler(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine.of(path)
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                ids: list[int] = []
                for part in batch.column("parts")[row].as_py():
                    ids = engine.join(ids, engine.unpack(part["ids"]))
                out.append((engine.pack(ids) if with_ids else None, *engine.summary(ids)))
            if out:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("th"), *columns], ["th", "ids", "n_tokens", "ids_sha", "text_sha"])

    return run


def shared_chunks(found: DataFrame) -> DataFrame:
    """(hi, lo, n, first): digests of the chunks that occur more than once in found, and the occurrence to encode."""
    many = found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "start")).alias("first"))
    return many.filter("n > 1")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded ids).

    with_ids adds ids, the token ids as little-endian numbers of two bytes (four for
    vocabularies of more than 65536 ids), for `decode_documents` and for writers of training shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    th = F.unhex(F.substr(F.sha2(text, 256), F.lit(1), F.lit(32)))
    src = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), th.alias("th"), text.alias("text"))
    texts = src.groupBy("th").agg(F.first("text").alias("text"))
    # chunks of copies are found where they are read and combined as digests, so texts move only to be encoded
    found = src.select("th", "text").mapInArrow(_find, "th binary, start int, stop int, hi long, lo long")
    if not Engine.of(path).local:
        found = found.limit(0)  # chunks of such a vocabulary can't be joined
    found = materialise(found.distinct(), "chunks")
    shared = materialise(shared_chunks(found), "shared-chunks")
    dealt = F.floor(F.col("n") / USES_A_PART + 1).cast("int")
    use = F.struct("start", "stop", "hi", "lo", dealt.alias("parts"), F.pmod(F.xxhash64("th", "start"), dealt).cast("int").alias("part"), (F.col("first") == F.struct("th", "start")).alias("own"))
    uses = join_counted(found, shared, ["hi", "lo"], ["th", "start"], "n").select("th", use.alias("use")).groupBy("th").agg(F.collect_list("use").alias("uses"))
    parts = materialise(texts.join(uses, "th", "left").select("th", "text", "uses").mapInArrow(_encoder(path, with_ids), _PART), "encoded")
    chunk = parts.filter("th is null").select("hi", "lo", "ids", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"))
    piece = parts.filter("th is not null and seg is not null")
    own = piece.filter("hi is null").select("th", "seg", "ids")
    reused = piece.filter("hi is not null").select("th", "seg", "hi", "lo", "part").join(chunk, ["hi", "lo", "part"]).select("th", "seg", "ids")
    built = own.unionByName(reused).groupBy("th").agg(F.array_sort(F.collect_list(F.struct("seg", "ids"))).alias("parts")).mapInArrow(_assembler(path, with_ids), _BUILT)
    done = parts.filter("th is not null and seg is null").select("th", "ids", "n_tokens", "ids_sha", "text_sha").unionByName(built)
    copies = materialise(src.groupBy("th").agg(F.count(F.lit(1)).alias("m")), "copies")
    out = join_counted(src.select("id", "uid", "th"), done, ["th"], ["uid"], "m", counted=copies)
    return out.select(F.col("id").alias(id_col), *["ids"] * with_ids, "n_tokens", F.lower(F.hex("ids_sha")).alias("ids_sha256"), F.lower(F.hex("text_sha")).alias("decoded_sha256"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded, a table with ids, with the column decoded in place of ids."""
    rest = [f for f in encoded.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine.of(path)
        for batch in batches:
            out = [None if ids is None else engine.decode(engine.unpack(ids)) for ids in batch.column("ids").to_pylist()]
            kept = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.string())], [*kept.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "decoded string"]))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict[str, str] = {}
