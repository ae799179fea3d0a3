"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

A text is encoded by a byte-level vocabulary A (a space before it) and by a piece
vocabulary B (which puts the space there itself).  Byte offsets where tokens of both
end cut the two sequences into groups; every token of A in a group is linked with every
token of B there.

1. One pass over the documents encodes and aligns them.  Its results are collected in
   blocks of documents: for each pair of ids a block has one row with compressed bitmaps
   over the block's documents, one bitmap for each binary digit of the pair's links in a
   document (its multiplicity planes).  A bitmap is a list of 16-bit numbers or, where
   dense, 65,536 bits.
2. A pair's bitmaps are OR-merged over its planes and popcounted: so many documents
   hold it.  Blocks are the high part of a document's number, so these counts add up over
   blocks.  The planes, weighted by their digit, give the links.
3. Each block's bitmaps meet the counts of their pairs and are read back as postings:
   every document gets the sum of its links' counts, and how many are the best of their A id.

Both vocabularies never join a character to a space behind it, so a text is aligned chunk
by chunk, a chunk being blanks and what follows them; every worker keeps what short
chunks gave in a table of bounded bytes.  The loader checks the vocabulary for this,
and a text in which a chunk's bytes do not come back is aligned as a whole.

Defined cases: texts that are null, empty, or whose tokens' bytes do not give the text back
have no tokens, zeros and an empty digest; repeated rows are documents of their own, null
ids too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import materialise

A_RANKS, A_JSON, B_MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents and links of a block at most (a single document may have more links).
BLOCK_DOCS, BLOCK_LINKS = 1 << 16, 1 << 22
#: Bits of an id and of a document's number in a block; together with the other id they make a 64-bit key.
ID_BITS, DOC_BITS = 23, 16
#: A bitmap of so many documents or more is written as bits.
DENSE = 4096
#: Bytes that a worker's table of chunks holds, and characters of a chunk kept there.
TABLE_BYTES, KEEP_CHARS = 192 << 20, 64
#: Texts, and chunks of them, that are looked up at once.
TEXTS, CHUNKS = 256, 1 << 16
#: Chunks that are encoded as one text, tokens that are aligned at once, and links of a group that are told one by one.
JOINED, TOKENS, LARGE = 1 << 15, 1 << 18, 1 << 10
#: Rows of an Arrow batch of bitmaps.
ROWS = 32_768

_CHUNK = re.compile(" *[^ ]+| +")
DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class Tokenizers:
    """Both vocabularies: ids of a text, bytes of an id."""

    def __init__(self, a_ranks: str = A_RANKS, a_json: str = A_JSON, b_model: str = B_MODEL):
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(a_ranks), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json, self._plain = public_tokenizers.path(a_json), None
        self._b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_model))
        self.a_bytes = {rank: word for word, rank in ranks.items()}
        self.b_bytes = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        self.a_lengths = np.zeros(max(self.a_bytes) + 2, np.int64)
        for i, word in self.a_bytes.items():
            self.a_lengths[i] = len(word)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Whether no piece of B has a space behind another character.
        self.by_chunk = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        if self._b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def a(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as e:  # the quick encoder gives up on very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self._plain is None:
                from tokenizers import Tokenizer

                self._plain = Tokenizer.from_file(self._json)
                self._plain.encode_special_tokens = True
            return self._plain.encode(text, add_special_tokens=False).ids

    def b(self, texts: str | list[str]) -> list:
        """The ids of a text, or of each of several."""
        return self._b.encode(texts, num_threads=1)

    def exact(self, data: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data


class Encoder:
    """Ids of both vocabularies for whole texts, as packed 32-bit numbers, chunk by chunk where that is exact.

    The table gives a short chunk's ids of A and B, or None if its bytes do not come back.  It has
    two halves: a full one becomes the old one, from which chunks that come again move over.
    """

    def __init__(self, tokenizers: Tokenizers, table_bytes: int = TABLE_BYTES):
        self.tokenizers, self.table_bytes = tokenizers, table_bytes
        self.table: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        """Have the short ones of these chunks in the table."""
        if self.held > self.table_bytes // 2:
            self.old, self.table, self.held = self.table, {}, 0
        old, new = self.old, []
        for c in set(chunks).difference(self.table):
            if len(c) <= KEEP_CHARS:
                if c in old:
                    self._keep(c, old[c])
                else:
                    new.append(c)
        joined = [c for c in new if c[-1] != " "]
        for at in range(0, len(joined), JOINED):
            self._together(joined[at : at + JOINED])
        for c in new:
            if c[-1] == " ":
                self._keep(c, self._both(c))

    def _keep(self, chunk: str, found) -> None:
        self.table[chunk] = found
        self.held += 300 + 4 * len(chunk) + (len(found[0]) + len(found[1]) if found else 0)

    def _both(self, chunk: str) -> tuple[bytes, bytes] | None:
        t = self.tokenizers
        a, b = t.a(chunk), t.b(chunk[1:])
        if not t.exact(chunk.encode("utf-8"), a, b):
            return None
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def _together(self, chunks: list[str]) -> None:
        """Chunks that end in no blank are encoded as one text; tokens of both end wherever a chunk does."""
        both = self._both("".join(chunks))
        if both is None:
            for c in chunks:
                self._keep(c, self._both(c))
            return
        ends, t = np.cumsum([len(c.encode("utf-8")) for c in chunks]), self.tokenizers
        cuts = []
        for data, lengths in zip(both, (t.a_lengths, t.b_lengths), strict=True):
            upto = np.cumsum(lengths[np.frombuffer(data, "<u4")])
            cuts.append([0, *(4 * (np.searchsorted(upto, ends) + 1)).tolist()])
        (a, b), (cut_a, cut_b) = both, cuts
        for n, c in enumerate(chunks):
            self._keep(c, (a[cut_a[n] : cut_a[n + 1]], b[cut_b[n] : cut_b[n + 1]]))

    def all(self, texts: list[str | None]):
        """For each text its ids of A and B, or None if it has no tokens."""
        if not self.tokenizers.by_chunk:
            yield from (self._both(" " + t) if t else None for t in texts)
            return
        waiting, size = [], 0
        for text in texts:
            chunks = _CHUNK.findall(" " + text) if text else []
            if size + len(chunks) > CHUNKS:
                yield from self._several(waiting)
                waiting, size = [], 0
            waiting.append((text, chunks))
            size += len(chunks)
        yield from self._several(waiting)

    def _several(self, waiting):
        if len(waiting) == 1:
            yield self._slices(*waiting[0])
            return
        self._learn([c for _, chunks in waiting for c in chunks])
        for text, chunks in waiting:
            found = self._looked_up(chunks) if text else None
            yield self._both(" " + text) if text and found is None else found

    def _slices(self, text: str | None, chunks: list[str]):
        """A text of any length, so many chunks at a time."""
        parts = []
        for at in range(0, len(chunks), CHUNKS):
            part = chunks[at : at + CHUNKS]
            self._learn(part)
            if (found := self._looked_up(part)) is None:
                return self._both(" " + text)
            parts.append(found)
        return (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])) if parts else None

    def _looked_up(self, chunks: list[str]) -> tuple[bytes, bytes] | None:
        table = self.table
        try:
            parts = [table[c] for c in chunks]
        except KeyError:
            parts = [table[c] if len(c) <= KEEP_CHARS else self._both(c) for c in chunks]
        if None in parts:
            return None
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


class Aligned:
    """The groups of several texts, whose ids lie one after another.

    ``of_a`` and ``of_b`` number each token's group, over all texts.
    """

    def __init__(self, tokenizers: Tokenizers, found: list[tuple[bytes, bytes]]):
        self.a = np.frombuffer(b"".join([a for a, _ in found]), "<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join([b for _, b in found]), "<u4").astype(np.int64)
        self.upto_a = np.cumsum([0, *(len(a) // 4 for a, _ in found)])
        self.upto_b = np.cumsum([0, *(len(b) // 4 for _, b in found)])
        ends_a, ends_b = np.cumsum(tokenizers.a_lengths[self.a]), np.cumsum(tokenizers.b_lengths[self.b])
        near = np.searchsorted(ends_b, ends_a)
        self.last_a = ends_b[near] == ends_a
        self.last_b = np.zeros(len(ends_b), bool)
        self.last_b[near[self.last_a]] = True
        self.of_a, self.of_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        self.close_a, close_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        self.size_a, self.size_b = np.diff(self.close_a, prepend=0), np.diff(close_b, prepend=0)
        self.begin_b = close_b - self.size_b
        #: The first group of each text, and one more.
        self.groups = np.append(0, np.cumsum(self.last_a)[self.upto_a[1:] - 1])

    def told(self, words: list[bytes], a_ids: int, b_ids: int) -> list[bytes]:
        """Each text's groups in decimal; ``words`` has A's ids before ``,`` and ``|``, then B's before ``,`` and ``;``."""
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.begin_b[self.of_a]] = self.a + a_ids * self.last_a
        order[np.arange(len(self.b)) + self.close_a[self.of_b]] = self.b + b_ids * self.last_b + 2 * a_ids
        cuts = (self.upto_a + self.upto_b).tolist()
        return [b"".join([words[i] for i in order[x:y].tolist()])[:-1] for x, y in zip(cuts, cuts[1:], strict=False)]

    def links(self) -> np.ndarray:
        """Links of each text."""
        return np.add.reduceat(self.size_a * self.size_b, self.groups[:-1])

    def keys(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(pair, document) keys with the texts' numbers, once for each link, or with the links beside them where
        a group is large."""
        text = np.repeat(numbers, np.diff(self.upto_a))
        large = self.size_a * self.size_b > LARGE
        n = np.where(large[self.of_a], 0, self.size_b[self.of_a])
        row = np.repeat(np.arange(len(n)), n)
        other = np.repeat(self.begin_b[self.of_a] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys = (((self.a[row] << ID_BITS) | self.b[other]) << DOC_BITS) | text[row]
        if not large.any():
            return keys, None
        parts, links = [keys], [np.ones(len(keys), np.int64)]
        for g in np.flatnonzero(large).tolist():
            a, n_a = np.unique(self.a[self.close_a[g] - self.size_a[g] : self.close_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.begin_b[g] : self.begin_b[g] + self.size_b[g]], return_counts=True)
            parts.append(((((a[:, None] << ID_BITS) | b) << DOC_BITS) | text[self.close_a[g] - 1]).ravel())
            links.append((n_a[:, None] * n_b).ravel())
        return np.concatenate(parts), np.concatenate(links)


def bitmaps(keys: np.ndarray, links: np.ndarray | None) -> pa.Table:
    """``a, b, docs, links, planes`` of a block from its (pair, document) keys.

    A key stands once for each link, or has its links beside it.
    """
    if links is None:
        keys = np.sort(keys)
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.diff(np.append(begins, len(keys)))
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.add.reduceat(links[order], begins)
    postings = keys[begins]
    pair, doc = postings >> DOC_BITS, (postings & ((1 << DOC_BITS) - 1)).astype("<u2")
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    docs, total = np.diff(np.append(first, len(pair))), np.add.reduceat(n, first)
    planes = _digits(np.maximum.reduceat(n, first))
    offset = np.append(0, np.cumsum(planes))
    own = np.repeat(offset[:-1], docs)
    cells, held = [], []
    for p in range(int(planes.max())):
        at = np.flatnonzero((n >> p) & 1)
        cells.append(own[at] + p)
        held.append(doc[at])
    cells, held = np.concatenate(cells), np.concatenate(held)
    order = np.argsort(cells, kind="stable")
    data = _binary(held[order], np.bincount(cells, minlength=offset[-1]))
    lists = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), data)
    pair = pair[first]
    columns = [(pair >> ID_BITS).astype(np.int32), (pair & ((1 << ID_BITS) - 1)).astype(np.int32), docs.astype(np.int64), total.astype(np.int64)]
    return pa.table([*map(pa.array, columns), lists], names=["a", "b", "docs", "links", "planes"])


def _digits(n: np.ndarray) -> np.ndarray:
    """Binary digits of positive numbers."""
    out, n = np.zeros(len(n), np.int64), n.copy()
    while n.any():
        out += n > 0
        n >>= 1
    return out


def _binary(docs: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bitmaps of the next ``sizes`` document numbers each."""
    dense = np.flatnonzero(sizes >= DENSE)
    upto = np.append(0, np.cumsum(sizes))
    if not len(dense):
        return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * upto).astype(np.int32)), pa.py_buffer(docs)])
    out, at = [], 0
    for d in dense.tolist():
        bits = np.zeros(1 << DOC_BITS, np.uint8)
        bits[docs[upto[d] : upto[d + 1]]] = 1
        out += [docs[upto[at] : upto[d]].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        at = d + 1
    out.append(docs[upto[at] :].tobytes())
    widths = 2 * sizes
    widths[dense] = (1 << DOC_BITS) // 8
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(widths)).astype(np.int32)), pa.py_buffer(b"".join(out))])


def postings(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and weight of every bit of the rows' planes; a row's weights of a document are its links."""
    lists = planes.combine_chunks() if isinstance(planes, pa.ChunkedArray) else planes
    count = np.asarray(lists.value_lengths())
    row = np.repeat(np.arange(len(count)), count)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    flat = lists.flatten()
    size = np.asarray(flat.cast(pa.large_binary()).value_lengths() if hasattr(flat, "value_lengths") else [len(x.as_py()) for x in flat], np.int64)
    wide = (1 << DOC_BITS) // 8
    sparse = np.flatnonzero(size != wide)
    narrow = np.frombuffer(b"".join(flat.take(pa.array(sparse)).to_pylist()), "<u2")
    rows, docs, weights = [np.repeat(row[sparse], size[sparse] // 2)], [narrow.astype(np.int64)], [np.repeat(np.int64(1) << plane[sparse], size[sparse] // 2)]
    for d in np.flatnonzero(size == wide).tolist():
        held = np.flatnonzero(np.unpackbits(np.frombuffer(flat[d].as_py(), np.uint8), bitorder="little"))
        rows.append(np.full(len(held), row[d]))
        docs.append(held)
        weights.append(np.full(len(held), np.int64(1) << plane[d]))
    return np.concatenate(rows), np.concatenate(docs), np.concatenate(weights)


class _Block:
    def __init__(self, encoder: Encoder, words: list[bytes], groups: bool):
        self.encoder, self.words, self.groups = encoder, words, groups
        self.docs: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray | None] = []
        self.size = 0

    def add(self, ids: list, found: list) -> None:
        """The next documents with their ids of A and B."""
        t, number = self.encoder.tokenizers, len(self.docs)
        blank = (0, 0, 0, 0, "", *[""] * self.groups)
        rows = [(number + n, doc_id, *blank) for n, doc_id in enumerate(ids)]
        held = [n for n, x in enumerate(found) if x is not None]
        if held:
            texts = Aligned(t, [found[n] for n in held])
            figures = [x.tolist() for x in (np.diff(texts.upto_a), np.diff(texts.upto_b), np.diff(texts.groups), texts.links())]
            for n, told, *numbers in zip(held, texts.told(self.words, len(t.a_lengths), len(t.b_lengths)), *figures, strict=True):
                rows[n] = (number + n, ids[n], *numbers, hashlib.sha256(told).hexdigest(), *[told.decode()] * self.groups)
            keys, links = texts.keys(np.array(held) + number)
            self.keys.append(keys)
            self.links.append(links)
            self.size += len(keys)
        self.docs += rows

    def bitmaps(self) -> pa.Table | None:
        if not self.size:
            return None
        keys = np.concatenate(self.keys)
        if all(n is None for n in self.links):
            return bitmaps(keys, None)
        return bitmaps(keys, np.concatenate([np.ones(len(k), np.int64) if n is None else n for k, n in zip(self.keys, self.links, strict=True)]))


_encoders: dict[tuple, tuple[Encoder, list[bytes]]] = {}


def _encoder(*names: str) -> tuple[Encoder, list[bytes]]:
    """One encoder for each choice of vocabularies and worker process, and the ids in decimal."""
    if names not in _encoders:
        t = Tokenizers(*names)
        words = [b"%d%s" % (i, mark) for ids, marks in ((len(t.a_lengths), b",|"), (len(t.b_lengths), b",;")) for mark in (marks[:1], marks[1:]) for i in range(ids)]
        _encoders[names] = Encoder(t), words
    return _encoders[names]


def _batches(ids: list, found):
    """Documents with their ids of A and B, about ``TOKENS`` tokens together."""
    at, held, size = 0, [], 0
    for x in found:
        held.append(x)
        size += (len(x[0]) + len(x[1])) // 4 if x else 0
        if size >= TOKENS:
            yield ids[at : at + len(held)], held
            at, held, size = at + len(held), [], 0
    if held:
        yield ids[at:], held


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = (A_RANKS, A_JSON, B_MODEL), with_groups: bool = False) -> DataFrame:
    """The written first pass: rows of documents (``number`` set) and of pairs' bitmaps (``a`` set) of each ``block``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, number int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string{', groups string' * with_groups}, a int, b int, docs long, links long, planes array<binary>"

    def flush(block: _Block, no: int, id_type):
        types = [pa.int32(), id_type, *[pa.int64()] * 4, *[pa.string()] * (1 + with_groups)]
        names_ = ["number", *DOC, *["groups"] * with_groups]
        own = pa.table([pa.array(c, t) for c, t in zip(zip(*block.docs, strict=True), types, strict=True)], names=names_)
        out = [own]
        if (maps := block.bitmaps()) is not None:
            out.append(maps)
        wide = pa.schema([("block", pa.int64()), *zip(names_, types, strict=True), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("links", pa.int64()), ("planes", pa.list_(pa.binary()))])
        for table in out:
            n, given = table.num_rows, set(table.column_names)
            columns = [pa.array(np.full(n, no)) if f.name == "block" else table.column(f.name) if f.name in given else pa.nulls(n, f.type) for f in wide]
            yield from pa.table(columns, schema=wide).to_batches(max_chunksize=ROWS)

    def run(batches):
        (encoder, words), no, id_type = _encoder(*names), TaskContext.get().partitionId() << 32, None
        block = _Block(encoder, words, with_groups)
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for ids, found in _batches(part.column(0).to_pylist(), encoder.all(part.column(1).to_pylist())):
                    block.add(ids, found)
                    if len(block.docs) > BLOCK_DOCS - TEXTS or block.size >= BLOCK_LINKS:
                        yield from flush(block, no, id_type)
                        block, no = _Block(encoder, words, with_groups), no + 1
        if block.docs:
            yield from flush(block, no, id_type)

    return materialise(rows.mapInArrow(run, schema), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, docs, links, best`` of every pair in the result of ``aligned``: in how many documents it is
    linked, how often, and whether no other pair of its ``a`` is in more."""
    counts = found.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = materialise(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def scored(found: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and ``groups``, if kept) of every document."""
    more = ["groups"] * ("groups" in found.columns)
    docs = found.where("number IS NOT NULL").select("block", "number", *DOC, *more)
    # Written, so that the join below stands between two plain shuffles and a hot pair can be split.
    # Both sides grow with the corpus: neither is ever broadcast.
    counts = materialise(pair_counts(found).select("a", "b", F.col("docs").alias("count"), "best"), "counts").hint("merge")
    maps = found.where("a IS NOT NULL").select("block", "a", "b", "planes").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "planes", "count", "best")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def returned(own: pa.Table, maps: pa.Table) -> pa.Table:
        number = own.column("number").to_numpy()
        best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
        for at in range(0, maps.num_rows, ROWS):
            part = maps.slice(at, ROWS)
            row, doc, weight = postings(part.column("planes"))
            np.add.at(total, doc, weight * part.column("count").to_numpy()[row])
            np.add.at(best, doc, weight * np.asarray(part.column("best")).astype(np.int64)[row])
        return own.append_column("n_best", pa.array(best[number])).append_column("count_sum", pa.array(total[number]))

    joined = docs.groupBy("block").cogroup(maps.groupBy("of")).applyInArrow(returned, f"{fields}, n_best long, count_sum long")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *more)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = (A_RANKS, A_JSON, B_MODEL), with_groups: bool = False) -> DataFrame:
    """Every document's alignment figures; see ``scored``."""
    return scored(aligned(docs, id_col, text_col, names, with_groups))
