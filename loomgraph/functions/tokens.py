"""Token counts and overlapping token windows, with an injectable tokenizer."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schemas import CHUNKS


class WordTokenizer:
    """White-space separated words."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in re.finditer(r"\S+", text)]

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


class RankTokenizer:
    """Byte-pair ranks in tiktoken's file format."""

    def __init__(self, path: str, pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") -> None:
        self.path, self.pattern = path, pattern

    def encode(self, text: str) -> list[int]:
        return _ranks(self.path, self.pattern).encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return _ranks(self.path, self.pattern).decode(tokens)

    def starts(self, text: str) -> list[int]:
        """The character at which each token begins; one that begins inside a character counts from that character."""
        ranks = _ranks(self.path, self.pattern)
        return ranks.decode_with_offsets(ranks.encode_ordinary(text))[1]


@lru_cache(maxsize=32)
def _ranks(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def word_count(text: Column) -> Column:
    """Native count of white-space separated words."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def quarter_count(text: Column) -> Column:
    """Native estimate: a quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def token_counter(tokenizer) -> Callable[[Column], Column]:
    """Exact counts as a vectorised function of a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda x: len(tokenizer.encode(x)))

    return F.pandas_udf(run, "int")


def check_window(most: int, overlap: int) -> None:
    if most <= 0 or overlap < 0 or overlap >= most:
        raise ValueError("need most > 0 and 0 <= overlap < most")


def chunk_words(files: DataFrame, most: int, overlap: int = 0, text: str = "text", source: str = "source_file") -> DataFrame:
    """Overlapping windows of words, in native expressions: source_file, index, text, token_count."""
    check_window(most, overlap)
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = files.select(F.col(source).alias("source_file"), F.col(text).alias("whole"), F.split(flat, " ").alias("w")).filter(F.trim("whole") != "")
    n, step = F.size("w"), most - overlap
    last = F.greatest(F.lit(0), F.ceil((n - most) / step)).cast("int")
    part = words.select("source_file", "whole", "w", F.posexplode(F.sequence(F.lit(0), last)).alias("index", "k"))
    piece = F.slice("w", F.col("k") * step + 1, most)
    return part.select("source_file", "index", F.when(n <= most, F.col("whole")).otherwise(F.array_join(piece, " ")).alias("text"), F.size(piece).alias("token_count"))


#: Blanks of all scripts that segments end at, and characters that are a segment each: scripts written without blanks
#: (Thai, Lao, Burmese, Khmer, Chinese, Japanese) and their signs. A segment of other scripts has LONGEST characters at most.
_BLANK = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SINGLE = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FFF}\x{3001}-\x{30FF}\x{3100}-\x{312F}\x{31A0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"
LONGEST = 32
#: Segments that one match of `chunk_segments` holds at most: Java's matcher goes a call deeper with each.
LONGEST_RUN = 200
LEADING, TRAILING = f"^[{_BLANK}]+", f"[{_BLANK}]+$"
SEGMENT = f"(?:[{_SINGLE}]|[^{_BLANK}{_SINGLE}]{{1,{LONGEST}}})[{_BLANK}]*"
#: The same for Java's matcher, which asks the ranges of a class one after the other: ASCII signs first.
_SEGMENT = f"(?:(?:[!-~[^{_BLANK}{_SINGLE}]]{{1,{LONGEST}}}|[{_SINGLE}])[{_BLANK}]*)"


def segments(text: Column) -> Column:
    """The segments of a text, each with the blanks after it: together the text without its leading blanks."""
    return F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))


def chunk_segments(files: DataFrame, most: int, overlap: int = 0, text: str = "text", source: str = "source_file") -> DataFrame:
    """Overlapping windows of segments, in native expressions: source_file, index, text, token_count and start.

    Pieces are slices of the original text (start counts its characters, from 0) without blanks at the end; a text of
    at most `most` segments stays verbatim, one without a segment gives nothing.
    """
    check_window(most, overlap)
    whole, step = F.col("whole"), most - overlap
    # windows begin and end at multiples of both: so many segments are one match, so a text has few elements to look at
    both = math.gcd(most, step)
    run = next(n for n in range(min(both, LONGEST_RUN), 0, -1) if both % n == 0)
    some = files.select(F.col(source).alias("source_file"), F.col(text).alias("whole")).filter(whole.rlike(f"[^{_BLANK}]"))
    runs = F.regexp_extract_all(whole, F.lit(f"{_SEGMENT}{{1,{run}}}"), F.lit(0))
    cut = some.select("source_file", "whole", runs.alias("w"))
    cut = cut.select("*", ((F.size("w") - 1) * run + F.size(segments(F.element_at("w", -1)))).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - most) / step)).cast("int")

    def piece(k: Column) -> Column:
        part = F.array_join(F.slice("w", k * (step // run) + 1, most // run), "")
        said = F.when(F.col("n") <= most, whole).otherwise(F.regexp_replace(part, TRAILING, ""))
        own = F.length(F.array_join(F.slice("w", k * (step // run) + 1, step // run), ""))
        return F.struct(said.alias("text"), F.least(F.lit(most), F.col("n") - k * step).cast("int").alias("token_count"), own.alias("own"))

    # pieces are cut while the text is one row; each then goes on with its own start
    cut = cut.select("source_file", F.length(F.regexp_extract(whole, LEADING, 0)).alias("lead"), F.transform(F.sequence(F.lit(0), last), piece).alias("pieces"))
    starts = F.aggregate("pieces", F.array("lead"), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["own"])))
    starts = F.when(F.size("pieces") == 1, F.array(F.lit(0))).otherwise(starts)
    part = cut.select("source_file", F.posexplode(F.zip_with("pieces", F.slice(starts, F.lit(1), F.size("pieces")), lambda x, at: x.withField("start", at))).alias("index", "p"))
    return part.select("source_file", "index", "p.text", "p.token_count", "p.start")


def chunk_tokens(files: DataFrame, most: int, overlap: int = 0, tokenizer=None, text: str = "text", source: str = "source_file") -> DataFrame:
    """Overlapping windows of any tokenizer's tokens; a text within `most` tokens stays verbatim.

    Pieces of a tokenizer that tells where its tokens start are slices of the text, so no character is cut in two.
    """
    check_window(most, overlap)
    tokenizer = tokenizer or WordTokenizer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, whole in zip(frame["source_file"], frame["text"], strict=True):
                tokens = tokenizer.encode(whole or "")
                if not tokens:
                    continue
                at_char = [*tokenizer.starts(whole), len(whole)] if hasattr(tokenizer, "starts") else None
                starts = range(0, max(1, len(tokens) - overlap), most - overlap)
                for i, at in enumerate(starts):
                    cut = tokens[at : at + most]
                    piece = tokenizer.decode(cut) if at_char is None else whole[at_char[at] : at_char[at + len(cut)]].rstrip()
                    rows.append((where, i, whole if len(tokens) <= most else piece, len(cut)))
            yield pd.DataFrame(rows, columns=["source_file", "index", "text", "token_count"])

    return files.select(F.col(source).alias("source_file"), F.col(text).alias("text")).mapInPandas(run, CHUNKS)
