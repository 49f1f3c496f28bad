"""Which rows share most members with each query, all rows against all queries, in bounded memory.

Queries go to the rows in blocks. A task takes rows in the order of their keys, some at a time: each
asked member has a byte for each of them, and a query's counts are the sum of its members' bytes. Queries
lie in the order of their members, those asked most often first, so that sums that begin alike are worked
out once. Of a query's rows those that beat its k-th so far stay; rows of equal counts come in the order
of their keys, so a later one of the same count never does. No row arises for a pair of query and row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries that go to the rows at once, their members, and rows of a task.
MAX_QUERIES, MAX_MEMBERS, TASK_ROWS = 1 << 15, 1 << 19, 1 << 20
#: Bytes of members by rows, and rows, that are worked on at once.
BYTES, ROWS = 1 << 25, 1 << 15


_NONE, _PLACES = np.zeros(0, np.int64), (1 << 40) - 1


class Block:
    """Some queries in the order of their members: keys, members as numbers, and how many members each has in common with the one before, from the first on."""

    def __init__(self, queries: list[tuple[int, list[str]]]):
        often = Counter(m for _, own in queries for m in own)
        names = sorted(often, key=lambda m: (-often[m], m))
        number = {m: i for i, m in enumerate(names)}
        ordered = sorted((sorted(number[m] for m in own), key) for key, own in queries if own)
        self.names, self.keys, self.members, self.alike = pa.array(names, pa.string()), np.array([key for _, key in ordered], np.int64), [own for own, _ in ordered], []
        before: list[int] = []
        for own in self.members:
            n = 0
            while n < min(len(own), len(before)) and own[n] == before[n]:
                n += 1
            self.alike.append(n)
            before = own


def blocks(queries: Iterator, most: int) -> Iterator[Block]:
    """Rows of (key, members) in blocks of a bounded size."""
    held, members = [], 0
    for key, own in queries:
        own = [m for m in own or () if m is not None]
        if held and (len(held) >= most or members + len(own) > MAX_MEMBERS):
            yield Block(held)
            held, members = [], 0
        held.append((key, own))
        members += len(own)
    if held:
        yield Block(held)


def _parts(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, row, member) of some rows at a time: which asked members they have."""
    most = max(64, min(ROWS, BYTES // max(1, len(block.names))))
    held, n = [], 0

    def joined():
        keys, row, member, first = [], [], [], 0
        for k, r, m in held:
            keys.append(k)
            row.append(r + first)
            member.append(m)
            first += len(k)
        return np.concatenate(keys), np.concatenate(row), np.concatenate(member)

    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            part = batch.slice(lo, most - n)
            lo, n = lo + part.num_rows, n + part.num_rows
            lists = part.column(1)
            at = pc.fill_null(pc.index_in(lists.flatten(), block.names), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            held.append((part.column(0).to_numpy(zero_copy_only=False), row[at >= 0], at[at >= 0]))
            if n == most:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _better(counts: np.ndarray, least: int, k: int) -> np.ndarray:
    """Places of counts over least; of more than k those of the k greatest, the first of equal ones."""
    over = counts > least
    n = np.count_nonzero(over)
    if n <= 4 * k:
        return np.flatnonzero(over) if n else _NONE
    reached = np.cumsum(np.bincount(counts)[::-1])[::-1]
    last = int(np.flatnonzero(reached >= k)[-1])
    return np.concatenate([np.flatnonzero(counts > last), np.flatnonzero(counts == last)[:k]])


def best(batches: Iterator[pa.RecordBatch], block: Block, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k rows of (key, members), in the order of their keys, that share most with each query."""
    members, alike = block.members, block.alike
    longest = max(map(len, members), default=0)
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    flat, starts = np.array([m for own in members for m in own], np.int64), np.cumsum([0, *map(len, members)])[:-1]
    # a count and a place in one number: the greater, the better
    found: list[np.ndarray] = [_NONE] * len(members)
    # plain numbers: beside one of numpy's, counts would be widened for each comparison
    least, all_keys, done, last = [0] * len(members), [], 0, None
    for keys, row, member in _parts(batches, block) if members else ():
        if (np.diff(keys) < 0).any() or (last is not None and keys[0] < last):
            raise ValueError("rows are not in the order of their keys")
        last = keys[-1]
        own = np.unique(member)
        at = np.full(len(block.names), len(own))
        at[own] = np.arange(len(own))
        # the last line: members that none of these rows has
        has = np.zeros((len(own) + 1, len(keys)), kind)
        has[at[member], row] = 1
        lines, could = list(has), np.add.reduceat((at < len(own))[flat].astype(np.int64), starts)
        where, able = at.tolist(), (could > np.array(least)).tolist()
        sums = list(np.zeros((longest + 1, len(keys)), kind))
        valid = 0
        for q, mine in enumerate(members):
            valid = min(valid, alike[q])
            if not able[q]:
                continue
            for j in range(valid, len(mine)):
                np.add(sums[j], lines[where[mine[j]]], out=sums[j + 1])
            valid = len(mine)
            counts = sums[valid]
            hit = _better(counts, least[q], k)
            if len(hit):
                all_found = np.concatenate([found[q], (counts[hit].astype(np.int64) << 40) | (_PLACES - done - hit)])
                all_found.sort()
                found[q] = all_found[-k:]
                if len(found[q]) == k:
                    least[q] = int(found[q][0]) >> 40
        all_keys.append(keys)
        done += len(keys)
    if done:
        keys, sizes = np.concatenate(all_keys), np.array([len(x) for x in found])
        codes = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.keys, sizes)), pa.array(keys[_PLACES - (codes & _PLACES)]), pa.array(codes >> 40)], names=names)
