"""Token counts that follow edits.

Each document has a tree over blocks of pre-tokens; every node holds the
characters and the tokens below it. An edit re-splits only the text from two
pre-tokens before it to the first old boundary that the new split meets again,
and updates the sums on the way from the touched blocks to the root. Blocks that
grow past twice their size are split, emptied ones go. Trees can be kept as a
table (`build_trees`), so that a later batch of edits encodes nothing but what
it touches (`edit_trees`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._shared import map_rows, table

#: Pre-tokens in a block of a fresh tree.
BLOCK = 64


class TokenTree:
    """A segment tree in two arrays of sums; node 1 is the root, node `width + b` block `b`."""

    def __init__(self, coder: bpe.Bpe, text: str, block: int = BLOCK, blocks: list[tuple[list[int], list[int]]] | None = None):
        """Encodes `text`, or takes the lengths and counts of its pre-tokens by block as they are."""
        self.coder, self.text, self.reencoded, self.block = coder, text, 0, block
        if blocks is None:
            pieces = coder.pattern.findall(text)
            blocks = [(list(map(len, pieces)), list(map(len, map(coder.pieces.__getitem__, pieces))))]
        self._build(blocks)

    def _build(self, blocks: list[tuple[list[int], list[int]]]) -> None:
        """Cuts blocks that are too large, drops empty ones and sums anew; encodes nothing."""
        n = self.block
        self.blocks = [(x[i : i + n], y[i : i + n]) if len(x) > 2 * n else (x, y) for x, y in blocks for i in range(0, len(x), n if len(x) > 2 * n else max(1, len(x)))] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for b, (x, y) in enumerate(self.blocks):
            self.chars[self.width + b], self.sums[self.width + b] = sum(x), sum(y)
        for node in range(self.width - 1, 0, -1):
            self._pull(node)
        self.empty = 0

    def _pull(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    @property
    def n_pieces(self) -> int:
        return sum(len(x) for x, _ in self.blocks)

    def _find(self, char: int) -> tuple[int, int]:
        """The block that holds character `char` (the last one with any, past the end) and where it starts."""
        node, start = 1, 0
        char = min(char, self.chars[1] - 1)
        while node < self.width:
            left = self.chars[2 * node]
            if char - start < left:
                node *= 2
            else:
                start += left
                node = 2 * node + 1
        return min(node - self.width, len(self.blocks) - 1), start

    def _before(self, b: int, start: int, i: int) -> tuple[int, int, int, int]:
        """The pre-token before the `i`-th of block `b`: block, its start, index, length."""
        while i == 0 and b > 0:
            b -= 1
            start -= self.chars[self.width + b]
            i = len(self.blocks[b][0])
        return (b, start, i - 1, self.blocks[b][0][i - 1]) if i else (b, start, 0, 0)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start..end by `new`; positions are cut to the text."""
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        # a pre-token depends on what it has and at most two characters behind it
        b, b_start = self._find(max(0, start - 2)) if n else (0, 0)
        i, at = 0, b_start
        lens = self.blocks[b][0]
        while i < len(lens) and at + lens[i] <= start - 2:
            at += lens[i]
            i += 1
        for _ in range(2):
            b, b_start, i, length = self._before(b, b_start, i)
            at -= length
        # old boundaries from the end of the edit on, by block
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        fresh: list[str] = []
        last, old_i, old_at = b, i, at  # the old pre-token that a boundary is compared with next
        done = False
        for m in self.coder.pattern.finditer(text, at):
            while old_at < end or old_at + shift < m.start():
                if old_i < len(self.blocks[last][0]):
                    old_at += self.blocks[last][0][old_i]
                    old_i += 1
                elif last + 1 < len(self.blocks):
                    last, old_i = last + 1, 0
                else:
                    break
            if m.start() >= start + len(new) and old_at >= end and old_at + shift == m.start():
                done = True
                break
            fresh.append(m.group())
        if not done:
            last, old_i = len(self.blocks) - 1, len(self.blocks[-1][0])
        counts = [len(self.coder.pieces[p]) for p in fresh]
        self.reencoded += len(fresh)
        kept = self.blocks[b][0][:i], self.blocks[b][1][:i]
        rest = self.blocks[last][0][old_i:], self.blocks[last][1][old_i:]
        self.text = text
        for k in range(b, last + 1):
            self.blocks[k] = ([], [])
        self.blocks[b] = (kept[0] + [len(p) for p in fresh], kept[1] + counts)
        if last == b:
            self.blocks[b] = (self.blocks[b][0] + rest[0], self.blocks[b][1] + rest[1])
        else:
            self.blocks[last] = rest
        self.empty += max(0, last - b - 1)
        if len(self.blocks[b][0]) > 2 * self.block or self.empty > len(self.blocks) // 2:
            self._build(self.blocks)
            return
        touched = {self.width + k for k in range(b, last + 1)}
        for node in touched:
            x, y = self.blocks[node - self.width]
            self.chars[node], self.sums[node] = sum(x), sum(y)
        while touched := {node // 2 for node in touched if node > 1}:
            for node in touched:
                self._pull(node)


def token_counts(docs: DataFrame, edits: Column | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Token counts of whole texts before and after a list of edits.

    `edits` is an array of struct<start int, stop int, new string> over `docs`,
    applied in order; each counts characters in the text as the ones before
    left it. Returns doc_id, n_pieces, n_tokens (before), n_tokens_edited,
    n_reencoded (pre-tokens split anew). A null text counts as empty; null
    edits are no edits, a null `new` deletes. Repeated rows each give a row.
    No shuffle; one document's tree lives only while its row is worked on.
    """
    kind = "array<struct<start:int,stop:int,new:string>>"
    edits = F.lit(None).cast(kind) if edits is None else edits.cast(kind)

    def make():
        coder = bpe.load(vocabulary)

        def work(c):
            out = {k: [] for k in ("n_pieces", "n_tokens", "n_tokens_edited", "n_reencoded")}
            for text, todo in zip(c["text"], c["edits"], strict=True):
                tree = TokenTree(coder, text or "")
                out["n_pieces"].append(tree.n_pieces)
                out["n_tokens"].append(tree.n_tokens)
                _apply(tree, todo)
                out["n_tokens_edited"].append(tree.n_tokens)
                out["n_reencoded"].append(tree.reencoded)
            return {"doc_id": c["doc_id"]} | out

        return work

    return map_rows(docs.select("doc_id", "text", edits.alias("edits")), make, "doc_id long, n_pieces long, n_tokens long, n_tokens_edited long, n_reencoded long")


TREE = "doc_id long, text string, blocks array<struct<lens:array<int>,counts:array<int>>>, n_tokens long"


def _stored(trees: list[TokenTree]) -> dict:
    return {"text": [t.text for t in trees], "blocks": [[{"lens": x, "counts": y} for x, y in t.blocks] for t in trees], "n_tokens": [t.n_tokens for t in trees]}


def build_trees(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, text, blocks (lengths and token counts of pre-tokens) and n_tokens of whole texts, to be written as a table.

    A null text counts as empty; repeated rows each give a row; other columns are ignored. No shuffle.
    """

    def make():
        coder = bpe.load(vocabulary)
        return lambda c: {"doc_id": c["doc_id"]} | _stored([TokenTree(coder, t or "") for t in c["text"]])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, TREE)


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """The trees after `edits` (doc_id, edits as in `token_counts`), and n_reencoded.

    Only what an edit touches is encoded. A tree without edits, or without
    doc_id, stays as it is; edits of a document that is not there go nowhere;
    several rows of edits for a document follow one another by their content.
    Of trees that repeat a doc_id each takes the edits.
    """
    flat = edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("e_id")).agg(F.flatten(F.sort_array(F.collect_list("edits"))).cast("array<struct<start:int,stop:int,new:string>>").alias("edits"))
    both = trees.select("doc_id", "text", "blocks").join(flat, F.col("doc_id") == F.col("e_id"), "left").drop("e_id")

    def make():
        coder = bpe.load(vocabulary)

        def work(c):
            made = []
            for text, blocks, todo in zip(c["text"], c["blocks"], c["edits"], strict=True):
                tree = TokenTree(coder, text, blocks=[(b["lens"], b["counts"]) for b in blocks])
                _apply(tree, todo)
                made.append(tree)
            return {"doc_id": c["doc_id"], "n_reencoded": [t.reencoded for t in made]} | _stored(made)

        return work

    return map_rows(both, make, TREE + ", n_reencoded long")


def _apply(tree: TokenTree, edits: list | None) -> None:
    for e in edits or []:
        if e is not None and e["start"] is not None and e["stop"] is not None:
            tree.edit(e["start"], e["stop"], e["new"] or "")


def sample_edits(text: str = "text") -> Column:
    """An insertion at the start, a replacement in the middle and a deletion near the end."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("int")
    one = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(new).alias("new"))
    return F.array(one(F.lit(0), F.lit(0), "Note: "), one(F.floor(n / 2), F.floor(n / 2) + 7, " re-written\n\nhere"), one(n - 9, n - 2, ""))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`: its tokens, and its tokens after three edits."""
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, sample_edits())


__all__ = ["TokenTree", "build_trees", "edit_trees", "op1_token_counts", "sample_edits", "token_counts"]
