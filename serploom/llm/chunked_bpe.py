"""BPE encoding with content-defined chunks that documents share.

A rolling hash over the last 32 bytes cuts every text where its upper bits are zero, so equal passages are cut
alike wherever they stand. Chunks that occur twice or more in the corpus are gathered once each by a shuffle
on their 128-bit key, encoded once, and joined back to the texts that hold them; a text without shared chunks
never leaves its task.

Repair of the joins: inside a shared chunk the tokens from its first blank to its last are kept. What lies between
two kept stretches (the end of one chunk, chunks that nobody shares, the start of the next) is encoded again as one
piece; a chunk without a blank is re-encoded with its neighbours, so the piece grows until it ends at
blanks on both sides. There old and new tokens agree exactly: the tokenizer drops blanks, and neither its
normaliser, its splitter nor its added tokens reach across one (``blank_separated`` probes this and refuses
other tokenizers).

Which chunks are shared is known to the tasks by a bit table of 16 bits a shared chunk, 8 MB at most. A false hit, as
come oftener once the table is full, only sends one more chunk through the shuffle; a hit without an
entry is encoded in place. Rows are never lost or changed by either.

Defined results: a null or empty text has no tokens; rows with equal texts have equal tokens; extra columns stay
untouched; an existing column of the output's name is refused; an empty table stays empty. A text is one cell and is
held by one task.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from serploom.llm.common import bytes_of, fresh, landed, mixed, refused

#: bytes of a chunk: least, expected beyond the least, most
LEAST, EXPECTED, MOST = 64, 256, 4096
#: bits of the table of shared chunks
BITS_A_CHUNK, MOST_BITS = 16, 1 << 26
#: pieces that a worker remembers, twice over
REMEMBERED = 150_000
#: bytes of texts whose new pieces are encoded in one call
GROUP = 1 << 17
#: texts whose tokens are put together at a time
SLICE = 512

_GEAR = mixed(np.arange(1, 257, dtype=np.uint64) << np.uint64(32)).astype(np.uint32)
_LIMIT = np.uint32((1 << 32) // EXPECTED)
_BLANKS = b" \t\n\x0b\x0c\r"
#: closing marks behind a letter or digit are tokens of their own, so a blank before them changes nothing
_CLOSING = re.compile(rb"(?<=[a-z0-9])([.,;:!?]+)(?=[\s]|$)")


# --- chunks


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text; no character is cut."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for back in (1, 2, 4, 8, 16):
        h[back:] += h[:-back] << np.uint32(back)
    inside = (b & 0xC0) == 0x80  # not the first byte of a character
    at = np.flatnonzero((h[:-1] < _LIMIT) & ~inside[1:]) + 1
    ends, start = [], 0
    for end in [*at.tolist(), n]:
        while end - start > MOST:
            forced = start + MOST
            while inside[forced] and forced > start:
                forced -= 1
            forced = forced if forced > start else start + MOST  # no UTF-8
            ends.append(forced)
            start = forced
        if end - start >= LEAST or end == n:
            ends.append(end)
            start = end
    return ends


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def key_of(data: bytes) -> tuple[int, int]:
    """128-bit key as two signed numbers."""
    key = xxhash.xxh3_128_intdigest(data)
    return signed(key >> 64), signed(key & 0xFFFFFFFFFFFFFFFF)


def chunks_of(data: bytes) -> list[tuple[int, int, tuple[int, int]]]:
    """(start, end, key) of the chunks."""
    ends = chunk_ends(data)
    return [(s, e, key_of(data[s:e])) for s, e in zip([0, *ends], ends)]


def probes(key: tuple[int, int], bits: int) -> tuple[int, ...]:
    mask = bits - 1
    return key[0] & mask, (key[0] >> 32) & mask, key[1] & mask, (key[1] >> 32) & mask


class BitTable:
    """Which keys may be shared."""

    def __init__(self, words: np.ndarray):
        self.bits, self.table = 64 * len(words), words.view(np.uint8)

    def __contains__(self, key: tuple[int, int]) -> bool:
        t = self.table
        return all(t[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits))


def any_hit(data: bytes, table: BitTable) -> bool:
    start = 0
    for end in chunk_ends(data):
        if key_of(data[start:end]) in table:
            return True
        start = end
    return False


def kept_part(chunk: bytes) -> tuple[int, int]:
    """From the first blank to the last, both included (none: empty)."""
    first, last = len(chunk), -1
    for blank in _BLANKS:
        at = chunk.find(blank)
        if at >= 0:
            first, last = min(first, at), max(last, chunk.rfind(blank))
    return (first, last + 1) if last > first else (0, 0)


# --- encoding


def blank_separated(tok: Tokenizer) -> bool:
    """Whether a text's tokens are those of its pieces between blanks: rules that rest on one piece, and a probe of all ASCII neighbours."""
    rules = json.loads(tok.to_str())
    steps = rules["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    splits = rules["pre_tokenizer"] or {}
    first = splits["pretokenizers"][0] if splits.get("type") == "Sequence" else splits
    if any(s["type"] not in ("NFC", "Lowercase", "Replace") for s in steps) or rules["post_processor"] or rules["decoder"]:
        return False
    if first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return False
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or len(a["content"].split()) != 1 for a in rules["added_tokens"]):
        return False
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    signs = [chr(c) for c in range(33, 127)]
    alone = {c: ids(c) for c in signs}
    blanks = _BLANKS.decode()
    return not any(ids(blanks + b) for b in blanks) and all(ids(a + blanks[(i + j) % 6] + b) == alone[a] + alone[b] for i, a in enumerate(signs) for j, b in enumerate(signs))


def lower_cased(rules: dict) -> tuple[bool, bool]:
    """Whether the tokenizer lower-cases, and whether letters, digits and other signs are never one token."""
    steps = rules["normalizer"] or {}
    splits = rules["pre_tokenizer"]
    first = splits["pretokenizers"][0] if splits["type"] == "Sequence" else splits
    parts = first["pattern"].get("Regex", "").split("|")
    return any(s["type"] == "Lowercase" for s in steps.get("normalizers", [steps])), parts[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]


def tokenizer_of(definition: str) -> Tokenizer:
    tok = Tokenizer.from_str(definition)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Encoder:
    """Encodes texts as int32 bytes; remembers pieces between blanks, a text's own and many more, dropping those not met for longest."""

    def __init__(self, definition: str):
        self.tok, self.young, self.old = tokenizer_of(definition), {}, {}
        rules = json.loads(definition)
        self.special = [a["content"].encode().lower() for a in rules["added_tokens"]]
        self.plain = all(lower_cased(rules))

    def learn(self, pieces: list[bytes]) -> None:
        """Tokens of pieces not remembered: all in one call, told apart by their offsets."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        found = self.tok.encode(" ".join(texts), add_special_tokens=False)
        ids, begins = np.array(found.ids, np.int32), np.array([a for a, _ in found.offsets], np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        if (begins[1:] < begins[:-1]).any():
            each = [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
        else:
            each = np.split(ids, np.searchsorted(begins, ends[:-1]))
        self.young.update(zip(pieces, [x.tobytes() for x in each], strict=True))

    def many(self, texts: list[bytes]) -> list[bytes]:
        rows = []
        for data in texts:
            if self.plain:
                lower = data.lower()  # A-Z; the tokenizer does the same and more
                if not any(special in lower for special in self.special):
                    data = _CLOSING.sub(rb" \1", lower)
            rows.append(data.split())
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        new = [p for p in dict.fromkeys(p for row in rows for p in row if p not in known)]
        known.update((p, old[p]) for p in new if p in old)
        new = [p for p in new if p not in old]
        if new:
            self.learn(new)
        return [b"".join(map(known.__getitem__, row)) for row in rows]

    def __call__(self, data: bytes) -> bytes:
        return self.many([data])[0]

    def in_groups(self, texts: list[bytes | None]) -> list[bytes | None]:
        """As ``many``, some texts at a time; null stays."""
        out: list[bytes | None] = [None] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t is not None:
                group.append(i)
                size += len(t)
            if group and (size > GROUP or i == len(texts) - 1):
                for at, ids in zip(group, self.many([texts[g] for g in group]), strict=True):
                    out[at] = ids
                group, size = [], 0
        return out

    def with_shared(self, data: bytes, shared: dict[tuple[int, int], bytes]) -> bytes:
        """Tokens of a text, those of the shared chunks' kept parts given."""
        between, kept, done = [], [], 0
        for start, end, key in chunks_of(data):
            ids = shared.get(key)
            if ids is not None:
                a, b = kept_part(data[start:end])
                if b > a:
                    between.append(data[done : start + a])
                    kept.append(ids)
                    done = start + b
        between.append(data[done:])
        return b"".join(x for pair in zip(self.many(between), [*kept, b""], strict=True) for x in pair)


_LOADED: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(definition)
    return _LOADED[key]


def _lists(ids: list[bytes | None]) -> pa.Array:
    """int32 bytes as array<int>, null where there are none."""
    sizes = [len(x) // 4 if x else 0 for x in ids]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    values = pa.array(np.frombuffer(b"".join(x for x in ids if x), np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in ids], pa.bool_()))


# --- the corpus


def shared_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keys h1, h2 of chunks that occur at least twice, with their number n."""

    @F.arrow_udf(returnType="array<struct<h1:bigint,h2:bigint>>")
    def keys(texts: pa.Array) -> pa.Array:
        of = [[{"h1": k[0], "h2": k[1]} for _, _, k in chunks_of(t.as_py())] for t in texts]
        return pa.array(of, pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))

    each = docs.select(F.explode(keys.asNondeterministic()(bytes_of(F.col(text)))).alias("k")).select("k.h1", "k.h2")
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")


def bit_table(shared: DataFrame) -> np.ndarray:
    """The table's 64-bit words, MOST_BITS / 64 at most."""
    bits = 1024
    wanted = min(MOST_BITS, BITS_A_CHUNK * shared.count())
    while bits < wanted:
        bits *= 2
    mask = bits - 1
    places = F.array(*[F.expr(f"{at} & {mask}L") for h in ("h1", "h2") for at in (h, f"shiftrightunsigned({h}, 32)")])
    words = (
        shared.select(F.explode(places).alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def with_token_ids(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds array<int>: the ids of the whole text. ``tokenizer``: path of a public tokenizer's JSON file, whose size is fixed."""
    refused(docs, out)
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    if not blank_separated(tokenizer_of(definition)):
        raise ValueError("this tokenizer's tokens reach across blanks")
    shared = landed(shared_chunks(docs, text), "shared-chunks")
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(shared))
    data = bytes_of(F.col(text))

    def hit_chunks(batches):
        """Each chunk that may be shared with the key of its text, and once in a while the chunk itself."""
        table, seen = BitTable(bits.value), set()
        for batch in batches:
            rows = []
            for t in batch.column(0):
                whole = t.as_py()
                hits = {key: (s, e) for s, e, key in chunks_of(whole) if key in table}
                of = key_of(whole) if hits else None
                for key, (s, e) in hits.items():
                    rows.append((*of, *key, None if key in seen else whole[s:e]))
                seen.update(hits)
            if len(seen) > 1_000_000:
                seen.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "h1", "h2", "chunk"])

    @F.arrow_udf(returnType="binary")
    def kept_ids(chunks: pa.Array) -> pa.Array:
        encode, of = encoder_of(definition), []
        for c in chunks:
            chunk = c.as_py()
            a, b = kept_part(chunk)
            of.append(chunk[a:b])
        return pa.array(encode.in_groups(of), pa.binary())

    hits = landed(docs.select(data.alias("t")).mapInArrow(hit_chunks, "k1 bigint, k2 bigint, h1 bigint, h2 bigint, chunk binary"), "hit-chunks")
    # each shared chunk is encoded once, and each text asks for each of its chunks once, however many copies there are
    chunks = hits.filter("chunk is not null").groupBy("h1", "h2").agg(F.any_value("chunk").alias("chunk"))
    entries = chunks.select("h1", "h2", kept_ids.asNondeterministic()("chunk").alias("ids"))

    @F.arrow_udf(returnType="k1 bigint, k2 bigint")
    def text_key(texts: pa.Array) -> pa.Array:
        table, keys = BitTable(bits.value), []
        for t in texts:
            whole = t.as_py()
            keys.append(key_of(whole) if any_hit(whole, table) else None)
        columns = [pa.array([k and k[i] for k in keys], pa.int64()) for i in (0, 1)]
        return pa.StructArray.from_arrays(columns, names=["k1", "k2"], mask=pa.array([k is None for k in keys], pa.bool_()))

    @F.arrow_udf(returnType="array<int>")
    def alone(texts: pa.Array) -> pa.Array:
        table, encode, parts = BitTable(bits.value), encoder_of(definition), []
        for at in range(0, len(texts), SLICE):  # a whole batch would be held several times over
            whole = [t.as_py() for t in texts[at : at + SLICE]]
            parts.append(_lists(encode.in_groups([None if any_hit(t, table) else t for t in whole])))
        return pa.concat_arrays(parts) if parts else _lists([])

    @F.arrow_udf(returnType="array<int>")
    def repaired(texts: pa.Array, given: pa.Array) -> pa.Array:
        encode, parts = encoder_of(definition), []
        for at in range(0, len(texts), SLICE):
            pairs = zip(texts[at : at + SLICE], given[at : at + SLICE], strict=True)
            parts.append(_lists([encode.with_shared(t.as_py(), {(x["h1"], x["h2"]): x["ids"] for x in g.as_py() or []}) for t, g in pairs]))
        return pa.concat_arrays(parts) if parts else _lists([])

    mark, k1, k2, given = fresh(docs, "mark", "k1", "k2", "given")
    marked = docs.withColumn(mark, text_key.asNondeterministic()(data)).filter(F.col(mark).isNotNull())
    marked = marked.withColumns({k1: F.col(mark).k1, k2: F.col(mark).k2})
    asked = hits.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "h1", "h2").distinct()
    answers = asked.join(entries, ["h1", "h2"]).groupBy(k1, k2).agg(F.collect_list(F.struct("h1", "h2", "ids")).alias(given))
    joined = marked.drop(mark).join(answers, [k1, k2], "left").withColumn(out, repaired.asNondeterministic()(data, F.col(given)))
    whole = docs.withColumn(out, alone.asNondeterministic()(data)).filter(F.col(out).isNotNull())
    return whole.unionByName(joined.select(*docs.columns, out))


def digests(ids: Column, tokenizer: str) -> Column:
    """Struct n_tokens, ids_sha256 (decimal ids joined by a blank), decoded_sha256 (of the decoded text)."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    texts: list[bytes] = []
    numbers: list[bytes] = []

    @F.arrow_udf(returnType="n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(values: pa.Array) -> pa.Array:
        if not texts:
            tok = tokenizer_of(definition)
            texts.extend((tok.id_to_token(i) or "").encode() for i in range(tok.get_vocab_size()))
            numbers.extend(b"%d" % i for i in range(len(texts)))
        sizes, a, b = [], [], []
        for v in values:
            of = v.values.to_numpy().tolist()
            sizes.append(len(of))
            a.append(hashlib.sha256(b" ".join(map(numbers.__getitem__, of))).hexdigest())
            # the tokenizer has no decoder (``blank_separated``): its tokens are joined by blanks
            b.append(hashlib.sha256(b" ".join(map(texts.__getitem__, of))).hexdigest())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest.asNondeterministic()(ids)
