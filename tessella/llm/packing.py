"""Packing of token streams into fixed windows by Karmarkar-Karp multiway differencing.

A document is tokenised whole and ended by one id. Full windows are cut off
first; the rest is cut into short pieces, which are gathered per task until
they fill a round of windows. Differencing then merges partial partitions, the
fullest slots of one with the emptiest of the other, until one partition of
near-equal windows is left. If a window is over capacity, the round is done
again with one window more.

Everything happens in one pass over the input: there is no shuffle, and a task
holds one round of pieces, whatever the size of its input.

Defined cases: a null or empty text is one piece with the end id alone; a null
id stays null; repeated rows are packed each on its own; an empty table gives
no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow

CAPACITY, PIECE, WINDOWS, SLACK = 1024, 128, 64, 4
LONG_BLANK = 1000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> tuple[list[int], int]:
    """The window of each size, and the fullest window's load, by multiway differencing into k windows.

    A partition is k loads in ascending order with the node in each slot (-1:
    empty). Merging adds loads in opposite order; two nodes that meet in a slot
    become children of a new node, so members are resolved once at the end.
    """
    n = len(sizes)
    if not n:
        return [], 0
    kids: list[tuple[int, int]] = []
    parts: list = []
    for i, s in enumerate(sizes):
        load, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        load[-1], node[-1] = s, i
        parts.append((load, node))
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (load_a, node_a), (load_b, node_b) = parts[a], parts[b]
        node_b = node_b[::-1]
        load, node = load_a + load_b[::-1], np.where(node_a >= 0, node_a, node_b)
        both = np.flatnonzero((node_a >= 0) & (node_b >= 0))
        node[both] = np.arange(n + len(kids), n + len(kids) + len(both))
        kids.extend(zip(node_a[both].tolist(), node_b[both].tolist(), strict=True))
        order = np.argsort(load, kind="stable")
        parts.append((load[order], node[order]))
        parts[a] = parts[b] = None
        heapq.heappush(heap, (-int(load[order[-1]] - load[order[0]]), len(parts) - 1))
    load, node = parts[heap[0][1]]
    window = [-1] * (n + len(kids))
    for w, x in enumerate(node.tolist()):
        if x >= 0:
            window[x] = w
    for x in range(len(kids) - 1, -1, -1):
        for y in kids[x]:
            window[y] = window[n + x]
    return window[:n], int(load[-1])


def windows_for(sizes: list[int], capacity: int) -> list[int]:
    """The least window count, from the total on upwards, at which differencing stays within capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, most = difference(sizes, k)
        if most <= capacity:
            return window
        k += 1


def long_blank(text: str) -> bool:
    """Whether a run of LONG_BLANK blanks may be in text: it covers a place of each LONG_BLANK // 2, and a quarter to one side of it."""
    step, part = LONG_BLANK // 2, LONG_BLANK // 4
    return any(text[i].isspace() and (text[i : i + part].isspace() or text[max(0, i - part + 1) : i + 1].isspace()) for i in range(0, len(text), step))


def encoder(path: str):
    """Token ids of a text, by the tokenizer file at path, its added tokens included. A rank file of the same vocabulary
    beside it is used where there is one, as it gives the same ids several times faster (tested, for every code point);
    else the file itself. Texts with long runs of white space, on which the rank encoder's stack grows with the run, are
    always left to the file."""
    import base64
    import importlib
    import json
    import os

    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    own = lambda text: file.encode(text, add_special_tokens=False).ids
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        # tokens that take in white space or need word ends are left to the file itself
        if not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            import tiktoken

            pattern = importlib.import_module("public_tokenizers").PATTERN
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={x["content"]: x["id"] for x in added})
            return lambda text: own(text) if long_blank(text) else fast.encode(text, allowed_special="all")
    return own


def packer(path: str, capacity: int, piece: int, with_ids: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        part = TaskContext.get().partitionId() << 32
        names = [*[x.split()[0] for x in SCHEMA.split(", ")], *["ids"] * with_ids]
        types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        target = WINDOWS * (capacity - SLACK) if capacity > 8 * SLACK else WINDOWS * capacity
        out: list[tuple] = []
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        state = {"sequence": part, "held": 0}

        def row(doc, start, ids, total, sequence, offset):
            base = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)
            out.append((*base, ids.astype(np.int32)) if with_ids else base)

        def settle():
            window, offset = windows_for([len(x[2]) for x in held], capacity), {}
            for (doc, start, ids, total), w in zip(held, window, strict=True):
                row(doc, start, ids, total, state["sequence"] + w, offset.get(w, 0))
                offset[w] = offset.get(w, 0) + len(ids)
            state["sequence"] += max(window, default=-1) + 1
            state["held"] = 0
            held.clear()

        def flush():
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        seen: dict[str, np.ndarray] = {}  # copies often stand close together
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = seen.get(text)
                if ids is None:
                    ids = np.array([*encode(text), end_id], "<u4")
                    if len(seen) >= 512:
                        seen.clear()
                    if len(text) < 20_000:
                        seen[text] = ids
                n = len(ids)
                full = n // capacity * capacity
                for s in range(0, full, capacity):
                    row(doc, s, ids[s : s + capacity], n, state["sequence"], 0)
                    state["sequence"] += 1
                s = full
                while s < n:
                    left = n - s
                    size = min(-(-left // -(-left // piece)), target - state["held"])
                    held.append((doc, s, ids[s : s + size], n))
                    state["held"] += size
                    s += size
                    if state["held"] >= target:
                        settle()
                if len(out) >= 4096:
                    yield flush()
        settle()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. with_ids adds the piece's token ids as array<int>; without it only their CRC is kept."""
    return narrow(docs, id_col, text_col).mapInArrow(packer(tokenizer_path, capacity, piece, with_ids, end_id), SCHEMA + ", ids array<int>" * with_ids)
