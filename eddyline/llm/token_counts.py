"""Token counts: batch encoding inside Arrow functions that return lengths only.

Method. A text is cut before every space that follows a non-blank character. The byte-level
pre-tokenizer never lets a token cross such a place (a token may start with a space but none
contains a later one, and no added token holds a space), so a text's count is the sum over its
cuts. What has no such place for more than ``LONG`` characters is cut further where a kind of characters ends: at other
white space, between ASCII letters and digits, at the full-width marks that end or part clauses. Counts of cuts are
remembered in a bounded table per worker; cuts not yet seen are encoded
in batches of about ``BATCH_BYTES`` bytes, however the texts' sizes vary. Only lengths leave
the worker. Texts are cut only for tokenizers that are known to allow it: a byte-level pre-tokenizer that splits by its pattern, no
normalizer, no added token with white space, digits or such marks, no truncation or padding; others get whole texts.

Defined results: null counts as the empty text (0 bytes, 0 tokens); a text of any length is
handled whole, one without any such place in one piece; equal rows get equal counts; an empty table gives an empty table; columns of the
input that have an output's name are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm import base, text_hash

BATCH_BYTES = 1 << 20
#: Entries of a worker's table of known cuts, and the longest cut kept there.
MEMO_ENTRIES, MEMO_LENGTH = 200_000, 64
#: Characters of a cut that is cut further, and of the pieces that it is put together to.
LONG, PIECE = 1 << 14, 1 << 12
_AFTER_BLANK = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_MARKS, _WIDE = "。、，！？；：", "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
_FURTHER = re.compile(
    rf"(?<=\S)(?=[\t\n\x0b\f\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[{_WIDE}A-Za-z0-9])(?=[{_MARKS}])|(?<=[{_MARKS}])(?=[{_WIDE}A-Za-z0-9])"
)
_ENCODERS: dict = {}


def may_be_cut(tokenizer: dict) -> bool:
    """Whether a tokenizer, as its file says, never joins what cuts part."""
    before = tokenizer.get("pre_tokenizer") or {}
    added = "".join(t["content"] for t in tokenizer.get("added_tokens") or [])
    plain = not any(tokenizer.get(k) for k in ("normalizer", "truncation", "padding"))
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return plain and byte_level and not re.search(rf"[\s0-9{_MARKS}]", added) and (tokenizer.get("post_processor") or {}).get("type") in (None, "ByteLevel")


def _encoder(data: bytes):
    import hashlib
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = (Tokenizer.from_str(data.decode()), may_be_cut(json.loads(data)), {}, {})
    return _ENCODERS[key]


def cuts(text: str) -> list[str]:
    """The pieces of a text between spaces that are safe; all but the first had a space before them, which is left out."""
    return _CUT.split(text) if _AFTER_BLANK.search(text) else text.split(" ")


def further(piece: str) -> list[str]:
    """A long piece in runs of about PIECE characters that end at safe places, as far as there are any."""
    out, at = [], 0
    for m in _FURTHER.finditer(piece):
        if m.start() - at >= PIECE:
            out.append(piece[at : m.start()])
            at = m.start()
    return [*out, piece[at:]]


def _batches(pieces: list[str]) -> Iterator[list[str]]:
    """Pieces in batches of BATCH_BYTES bytes at most, a larger one alone; in one if they are that few."""
    if 4 * sum(map(len, pieces)) <= BATCH_BYTES:
        if pieces:
            yield pieces
        return
    batch, size = [], 0
    for piece in pieces:
        n = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if batch and size + n > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += n
    yield batch


class Counter:
    """Counts tokens of texts with one tokenizer; remembers the counts of short pieces."""

    def __init__(self, data: bytes):
        self.encoder, self.may_cut, self.first, self.later = _encoder(data)

    def _learn(self, pieces: list[str], lead: str, memo: dict) -> None:
        for batch in _batches(pieces):
            found = self.encoder.encode_batch_fast([lead + p for p in batch] if lead else batch, add_special_tokens=False)
            memo.update(zip(batch, map(len, found), strict=True))

    def _split(self, text: str) -> tuple[list[str], list[str]]:
        """What begins a text or goes on without a space, and what a space was before."""
        if not self.may_cut:
            return [text], []
        first, *later = cuts(text)
        bare = [first]
        if len(text) > LONG:
            bare = further(first)
            for k, piece in enumerate(later):
                if len(piece) > LONG:
                    later[k], *rest = further(piece)
                    bare += rest
        return bare, later

    def counts(self, texts: list[str]) -> list[int]:
        """All texts' counts. The texts of one call together should be of bounded size."""
        split = [self._split(t) if t else ([], []) for t in texts]
        long = []
        for place, (lead, memo) in enumerate((("", self.first), (" ", self.later))):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            fresh = list(set(chain.from_iterable(s[place] for s in split)).difference(memo))
            self._learn(fresh, lead, memo)
            long.append([p for p in fresh if len(p) > MEMO_LENGTH])
        out = [sum(map(self.first.__getitem__, bare)) + sum(map(self.later.__getitem__, later)) for bare, later in split]
        for memo, pieces in zip((self.first, self.later), long, strict=True):
            for p in pieces:
                del memo[p]
        return out


def count_tokens(
    docs: DataFrame, tokenizer: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens"
) -> DataFrame:
    """Adds each text's UTF-8 bytes and tokens. tokenizer: path of a tokenizers .json file, read
    once here and sent to the executors (vocabulary files are a few MB at most)."""
    with open(tokenizer, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a tokenizer file of more than 64 MB is not sent to every executor")
    base.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(data)
    own = base.spare(docs, "__text")

    @F.arrow_udf("int")
    def tokens(batched: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(held.value)
        for array in batched:
            out: list[int] = []
            for start, n in text_hash.slices(array, BATCH_BYTES):  # of about so many bytes, a longer text alone
                out += counter.counts(array.slice(start, n).to_pylist())
            yield pa.array(out, pa.int32())

    return (
        base.fresh(docs.withColumn(own, F.coalesce(F.col(text), F.lit(""))), n_bytes, n_tokens)
        .withColumn(n_bytes, F.octet_length(own).cast("long"))
        .withColumn(n_tokens, tokens(own).cast("long"))
        .drop(own)
    )


LIMIT = 512


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
