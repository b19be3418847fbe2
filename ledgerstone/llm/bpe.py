"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last ``WINDOW`` bytes has
``MASK_BITS`` zero bits, so equal passages of different documents give equal
chunks. A chunk's inside, from its first white space to its last, is encoded
once while the worker's cache holds it. The piece around each chunk join, which
grows over further chunks until both of its sides are white space, is then
encoded anew together with the words on both sides of it, by the ``tokenizers``
library on the text as it stands; it is widened by a word on each side until
its ids begin and end with the ids that the chunks gave those words, so that
the joined ids are exactly those of the whole text.

A tokenizer is refused unless ASCII white space always ends a word of it, which
is checked on its file (``modelled``).

Null texts count as empty (no ids; decoded text empty). Very long texts are
cut like others. Repeated rows and ties are encoded each; empty tables give
empty results. Other columns pass through; those named as an output column are
replaced. Caches are emptied when full, which changes no result.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import arrow_text as at
from ledgerstone.llm.shared import other_columns

WINDOW = 16
MASK_BITS = 9
#: Entries after which a worker's chunks are dropped and its words become the old generation.
CHUNKS_KEPT = 8_000
WORDS_KEPT = 150_000
_workers: dict[str, Encoder] = {}


#: The parts of the one kind of tokenizer that the chunks and the word cache hold for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def modelled(config: dict) -> str:
    """What of a tokenizer's file differs from the modelled kind; empty if nothing does."""
    step = config.get("pre_tokenizer") or {}
    first, *rest = step.get("pretokenizers") or [{}]
    model, added = config.get("model") or {}, config.get("added_tokens") or []
    wrong = {
        "normalizer": (config.get("normalizer") or {}).get("normalizers") != NORMALIZERS,
        "split": (first.get("pattern"), first.get("behavior"), first.get("invert")) != ({"Regex": SPLIT}, "Removed", True),
        "byte level": [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] != [("ByteLevel", False, False)],
        "model": model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "decoder": config.get("decoder") is not None or config.get("post_processor") is not None,
        "added tokens": any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<|") or t["content"].split() != [t["content"]] for t in added),
    }
    return ", ".join(k for k, bad in wrong.items() if bad)


class Encoder:
    """Encodes bytes to token ids, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            found = modelled(json.load(f))
        if found:
            raise ValueError(f"{path} is not a tokenizer that is modelled here: {found}")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        size = self.tok.get_vocab_size(True)
        self.names, self.closing = [b""] * size, np.zeros(size, bool)
        for token, i in self.tok.get_vocab(True).items():
            self.names[i] = b" " + token.encode()
            self.closing[i] = token.endswith("</w>")
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}

    def learn(self, words: set[bytes]) -> None:
        """Cache the ids of words: their keys that are new are encoded, plain ones in one text, others each by itself."""
        old, parted, new = self.old, {}, set()
        for w in words:
            if w in old:
                self.ids[w] = old[w]
            else:
                parted[w] = keys_of(w)
                for k in parted[w]:
                    if k in old:
                        self.ids[k] = old[k]
                    elif k not in self.ids:
                        new.add(k)
        plain = [w for w in new if w.isalpha()]  # ASCII letters only, so one split of the tokenizer each
        if plain:
            ids = np.array(self.tok.encode(b" ".join(plain).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(plain):
                raw, at_ = ids.tobytes(), 0
                for w, e in zip(plain, (ends * 4).tolist(), strict=True):
                    self.ids[w] = raw[at_:e]
                    at_ = e
                new = [w for w in new if not w.isalpha()]
        for w, e in zip(new, self.tok.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.ids[w] = np.array(e.ids, "<u4").tobytes()
        for w, keys in parted.items():
            self.ids[w] = b"".join([self.ids[k] for k in keys])

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the tokenizer's decode() with special tokens: it has no decoder, so tokens joined by a space."""
        names = self.names
        return b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]

    def encode(self, texts: list[bytes], cuts: list[list[int]]) -> list[bytes]:
        """cuts: the ends of each text's chunks, in order, the text's end last."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks = {}
        if len(self.ids) > WORDS_KEPT:
            self.ids, self.old = {}, self.ids
        plans, need, have, joins = [], set(), self.ids, []
        for text, ends in zip(texts, cuts, strict=True):
            plan, start, carry = [], 0, b""
            for end in ends:
                chunk = text[start:end]
                known = self.chunks.get(chunk)
                if known is None:
                    known = self.chunks[chunk] = _parts(chunk)
                head, middle, tail = known
                carry += head
                if middle is not None:  # else no white space: the join's piece goes on
                    if carry:
                        joins.append((plan, len(plan), carry))
                        plan.append(None)
                    plan.append(middle)
                    carry = tail
                start = end
            if carry:
                joins.append((plan, len(plan), carry))
                plan.append(None)
            for part in plan:
                if part is not None and part.ids is None:
                    need.update([w for w in part.words.split() if w not in have])
            plans.append(plan)
        self.learn(need)
        for plan in plans:
            for part in plan:
                if part is not None and part.ids is None:
                    part.fix(have)
        self.repair(joins)
        return [b"".join([part if isinstance(part, bytes) else part.ids for part in plan]) for plan in plans]

    def repair(self, joins: list[tuple[list, int, bytes]]) -> None:
        """Put the ids of each join's piece into its plan: (plan, place, piece)."""
        width = 1
        while joins:
            sides = [(_before(plan, at_, width), _after(plan, at_, width)) for plan, at_, _ in joins]
            texts = [b" ".join([*a[0], piece, *b[0]]).decode() for (_, _, piece), (a, b) in zip(joins, sides, strict=True)]
            open_ = []
            for join, (a, b), e in zip(joins, sides, self.tok.encode_batch(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4").tobytes()
                if ids.startswith(a[1]) and ids.endswith(b[1]) and len(ids) >= len(a[1]) + len(b[1]):
                    join[0][join[1]] = ids[len(a[1]) : len(ids) - len(b[1])]
                elif len(a[0]) < width and len(b[0]) < width:
                    raise ValueError("chunks and their join don't agree")  # as wide as both chunks
                else:
                    open_.append(join)
            joins, width = open_, 2 * width


def _before(plan: list, at_: int, width: int) -> tuple[list[bytes], bytes]:
    """The last words, at most ``width``, of the chunk before a join, and their ids."""
    part = plan[at_ - 1] if at_ else None
    return part.end(width, True) if isinstance(part, _Words) else ([], b"")


def _after(plan: list, at_: int, width: int) -> tuple[list[bytes], bytes]:
    part = plan[at_ + 1] if at_ + 1 < len(plan) else None
    return part.end(width, False) if isinstance(part, _Words) else ([], b"")


class _Words:
    """The whole words inside a chunk: their ids, and the ends of each word's ids."""

    __slots__ = ("ids", "ends", "words")

    def __init__(self, words: list[bytes]):
        self.words, self.ids, self.ends = b" ".join(words), None, None

    def fix(self, have: dict[bytes, bytes]) -> None:
        parts = [have[w] for w in self.words.split()]
        self.ids, self.ends = b"".join(parts), array("I", accumulate(map(len, parts)))

    def end(self, width: int, last: bool) -> tuple[list[bytes], bytes]:
        """The last or first words and their ids."""
        words = self.words.rsplit(None, width)[-width:] if last else self.words.split(None, width)[:width]
        n = len(words)
        if last:
            return words, self.ids[self.ends[-n - 1] if n < len(self.ends) else 0 :] if n else b""
        return words, self.ids[: self.ends[n - 1]] if n else b""


def _parts(chunk: bytes) -> tuple[bytes, _Words | None, bytes]:
    """The piece before the first white space, the words inside, the piece after the last white space."""
    words = chunk.split()
    if not words:
        return b"", _Words([]), b""
    head = b"" if at.SPACE[chunk[0]] else words[0]
    tail = b"" if at.SPACE[chunk[-1]] else words[-1]
    if len(words) == 1 and head and tail:
        return head, None, b""
    if chunk.isascii() and b"<|" not in chunk:
        words = chunk.lower().split()
    return head, _Words(words[bool(head) : len(words) - bool(tail)]), tail


#: Marks that end a word's run of letters or digits and belong to no special token or contraction.
MARKS = b".,!?;:*%$&#"


def _stays_letter(c: str) -> bool:
    """Whether a letter still ends in a letter once composed and lowered; else its mark joins the closing marks."""
    return c.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", c).lower())[-1].isalpha()


def keys_of(word: bytes) -> list[bytes]:
    """Cache keys whose ids, joined, are the word's ids.

    A word is cut before its closing marks, where the tokenizer's split cuts
    it too, and ASCII letters are lowered as the tokenizer does, save next to
    other characters (composition comes first there) or a special token.
    """
    if word.isascii() and b"<|" not in word:
        word = word.lower()
    if word[-1] in MARKS:
        core = word.rstrip(MARKS)
        if core and (core[-1:].isalnum() or (core[-1] >= 128 and _stays_letter(core.decode()[-1]))):
            return [core, word[len(core) :]]
    return [word]


def chunk_ends(buf: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of the content-defined chunks of each row, relative to the row; the row's end is the last."""
    ends = [[] for _ in range(len(offsets) - 1)]
    if len(buf) > WINDOW:
        h = at.prefix_hash(buf + np.uint64(1))
        rolling = at.span_hash(h, np.arange(len(buf) - WINDOW), np.arange(WINDOW, len(buf)))
        cut = np.flatnonzero(rolling & np.uint64((1 << MASK_BITS) - 1) == 0) + WINDOW
        cut = cut[buf[cut] & 0xC0 != 0x80]  # between code points
        row = np.searchsorted(offsets, cut, "right") - 1
        whole = cut - offsets[row] >= WINDOW
        for r, c in zip(row[whole].tolist(), (cut - offsets[row])[whole].tolist(), strict=True):
            ends[r].append(c)
    for r, size in enumerate(np.diff(offsets).tolist()):
        if size and (not ends[r] or ends[r][-1] != size):
            ends[r].append(size)
    return ends


def encode_batches(batches: Iterator[pa.RecordBatch], column: str, path: str, give_ids: bool) -> Iterator[pa.RecordBatch]:
    worker = _workers.get(path)
    if worker is None:
        worker = _workers[path] = Encoder(path)
    for batch in batches:
        buf, offsets = at.column_bytes(batch.column(column))
        kept = [c for c in batch.schema.names if c != column]
        for lo, hi in at.slices(offsets):
            counts, digests, decoded, ids = [], [], [], []
            a, b = offsets[lo], offsets[hi]
            part, off = buf[a:b], offsets[lo : hi + 1] - a
            raw, bounds = part.tobytes(), off.tolist()
            texts = [raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
            for x in worker.encode(texts, chunk_ends(part, off)):
                counts.append(len(x) // 4)
                digests.append(hashlib.sha256(x).hexdigest())
                decoded.append(hashlib.sha256(worker.decode(x)).hexdigest())
                if give_ids:
                    ids.append(np.frombuffer(x, "<u4").astype(np.int32))
            more = [pa.array(ids, pa.list_(pa.int32()))] if give_ids else []
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *more, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], [*kept, *["ids"] * give_ids, "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, column: str = "text", give_ids: bool = True) -> DataFrame:
    """The other columns of docs with ids (array<int>, if asked for), n_tokens, ids_sha256, decoded_sha256.

    path: the tokenizer's JSON file, found at the same place on every executor.
    """
    new = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if not give_ids:
        new.pop("ids")
    kept = [F.col(f"`{c}`") for c in other_columns(docs, [column, *new])]
    schema = docs.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    return docs.select(*kept, F.col(column)).mapInArrow(lambda b: encode_batches(b, column, path, give_ids), schema)
