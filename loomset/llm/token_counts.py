"""Edit-aware token counts: a tree of counts over pre-token runs for each document; an edit re-encodes only what it touches.

A leaf is a run of whole pre-tokens of about LEAF characters that begins where white space follows something else. There the tokenizer's pattern
always ends a pre-token and looks neither back nor across, so leaves can be encoded alone and their counts add up. Counts stand in an array tree
whose nodes hold the sums of their two children. An edit takes the leaves that it touches and the context up to the next leaf boundary, cuts and
encodes their new text, and updates the sums above. `kept_trees` keeps the documents' trees beside their texts as a column, to be written as a table;
`count_edited` starts from that column where it is given, encodes nothing but what edits touch, and returns the trees as the edits leave them.

Defined cases: a null tree, or one of another text, is made anew; a null text counts as empty, with 0 tokens; edits beyond the text's end are clipped to it; an edit list may be null or empty; edits
apply in order, each to the text as left by those before; strings of special tokens are ordinary text; whole texts of any length count;
repeated rows count alike; further columns are carried, but for those with the names of results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomset.llm.common import ready, settle

#: Where the tokenizer's ranks lie; read by the driver and broadcast, about 1 MB.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LEAF = 400
_BOUNDARY = re.compile(r"(?<=\S)(?=\s)")
ADDED = ("n_tokens", "n_tokens_after", "n_leaves", "n_encoded", "edited", "edited_tree")
EDIT = "array<struct<start:bigint,deleted:bigint,inserted:string>>"

#: A kept tree: a digest of its text, the number of leaves, and the characters and tokens of all nodes, the root at 1.
TREE = "struct<digest:binary,leaves:bigint,chars:array<bigint>,tokens:array<bigint>>"

_encodings: dict[tuple[bytes, str], tiktoken.Encoding] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    key = (hashlib.sha256(ranks).digest(), PATTERN)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _encodings[key]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = _BOUNDARY.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


class Tree:
    """Leaves' texts, and sums of token and character counts in array trees: node i has the children 2 i and 2 i + 1."""

    def __init__(self, text: str, encode, kept: dict | None = None) -> None:
        self.encode, self.encoded = encode, 0
        if kept and kept["digest"] == _digest(text):
            self.texts, self.chars, self.tokens, self.width, at = [], list(kept["chars"]), list(kept["tokens"]), len(kept["chars"]) // 2, 0
            for size in self.chars[self.width : self.width + kept["leaves"]]:
                self.texts.append(text[at : at + size])
                at += size
        else:
            self._build([(x, self._count(x)) for x in leaves(text)])

    def keep(self) -> dict:
        return {"digest": _digest(self.text), "leaves": len(self.texts), "chars": self.chars, "tokens": self.tokens}

    def _count(self, text: str) -> int:
        self.encoded += 1
        return len(self.encode(text))

    def _build(self, counted: list[tuple[str, int]]) -> None:
        self.texts = [x for x, _ in counted]
        self.width = 1 << max(0, (len(counted) - 1).bit_length())
        self.tokens, self.chars = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (x, n) in enumerate(counted):
            self.tokens[self.width + i], self.chars[self.width + i] = n, len(x)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one, and where it begins: down the tree by character sums."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if place >= begin + self.chars[i] and begin + self.chars[i] < self.chars[1]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(start + deleted, self.chars[1]))
        if not self.texts:
            self._build([(x, self._count(x)) for x in leaves(inserted)])
            return
        first, begin = self.find(start)
        last, last_begin = self.find(stop)
        if start == begin and first:  # the boundary before may go
            first -= 1
            begin -= len(self.texts[first])
        middle = "".join(self.texts[first : last + 1])
        middle = middle[: start - begin] + inserted + middle[stop - begin :]
        # the boundary behind holds only between non-space and space
        while last + 1 < len(self.texts) and not (middle and not middle[-1].isspace() and self.texts[last + 1][:1].isspace()):
            last += 1
            middle += self.texts[last]
        while first and not (middle and middle[0].isspace()):
            first -= 1
            middle = self.texts[first] + middle
        fresh = [(x, self._count(x)) for x in leaves(middle)]
        if len(fresh) == last - first + 1:
            for i, (x, n) in enumerate(fresh):
                self.texts[first + i] = x
                self.tokens[self.width + first + i], self.chars[self.width + first + i] = n, len(x)
            low, high = (self.width + first) // 2, (self.width + last) // 2
            while low:
                for i in range(low, high + 1):
                    self._sum(i)
                low, high = low // 2, high // 2
        else:  # the number of leaves changed: their counts stay, only sums are made anew
            counted = list(zip(self.texts, self.tokens[self.width : self.width + len(self.texts)], strict=True))
            self._build(counted[:first] + fresh + counted[last + 1 :])

    @property
    def text(self) -> str:
        return "".join(self.texts)


def read_ranks(spark: SparkSession, path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _trees(docs: DataFrame, carry: list[str], inputs: list[str], added: list[T.StructField], ranks: str, each) -> DataFrame:
    """The carried columns with those added: each(encode, row of the inputs) gives their values."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks))
    schema = T.StructType([docs.schema[c] for c in carry] + added)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                rows = [each(encode, *row) for row in zip(*[batch.column(c).to_pylist() for c in inputs], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in carry] + [pa.array(x, arrow.field(f.name).type) for x, f in zip(zip(*rows, strict=True), added, strict=True)], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, *inputs])).mapInArrow(run, schema)


def kept_trees(docs: DataFrame, ranks: str = RANKS, carry: list[str] | None = None) -> DataFrame:
    """docs with `tree`, in place of a column of that name: the tree of text, of type TREE. Every leaf is encoded once, here."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "tree"]
    return _trees(docs, carry, ["text"], [T.StructField("tree", T._parse_datatype_string(TREE))], ranks, lambda encode, text: (Tree(text or "", encode).keep(),))


def count_edited(docs: DataFrame, edits: str = "edits", ranks: str = RANKS, carry: list[str] | None = None, tree: str | None = None) -> DataFrame:
    """docs (text, the column `edits` of type EDIT, and the kept trees in the column `tree`, if named) with n_tokens, n_tokens_after, n_leaves, n_encoded (leaves encoded for the edits, and for trees made anew where trees were given), the text after the edits as `edited` and its tree as `edited_tree`."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (edits, tree) and c.lower() not in ADDED]

    def each(encode, text: str | None, changes: list | None, kept: dict | None = None) -> tuple:
        own = Tree(text or "", encode, kept)
        before, built = own.total, 0 if tree else own.encoded
        for e in changes or ():
            if e is not None:
                own.edit(e["start"] or 0, max(0, e["deleted"] or 0), e["inserted"] or "")
        return before, own.total, len(own.texts), own.encoded - built, own.text, own.keep()

    added = [*[T.StructField(c, T.LongType()) for c in ADDED[:4]], T.StructField("edited", T.StringType()), T.StructField("edited_tree", T._parse_datatype_string(TREE))]
    return _trees(docs, carry, ["text", edits, *([tree] if tree else [])], added, ranks, each)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents, whose trees are kept as a table first, each with three edits that follow from its id: a word replaced near the middle, a stretch deleted, and a line added at the end."""
    docs = settle(kept_trees(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "trees")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1)))
    edit = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), deleted.cast("long").alias("deleted"), inserted.alias("inserted"))
    edits = F.array(edit(F.floor(n / 2), F.lit(5), F.lit("word's")), edit(place, F.lit(40), F.lit("")), edit(n * 2, F.lit(0), F.concat(F.lit("\nRevision "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("."))))
    counted = count_edited(docs.withColumn("edits", edits), carry=["doc_id"], tree="tree")
    return counted.select("doc_id", "n_tokens", "n_tokens_after", F.length("edited").cast("long").alias("n_chars_after"), F.sha2("edited", 256).alias("text_sha256_after"), "n_leaves", "n_encoded")
