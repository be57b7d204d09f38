"""The run of a page's words that is most like a text, by a positional index of the page's words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Starts that are looked at together at first, four times as many each time after, and at most.
FIRST, MOST = 64, 16_384
#: Tokens of a text whose first starts are looked through for the whole text before any scores are made.
SHORT = 32


class PageIndex:
    """A page's normalised words (each of no, one or several tokens): where each token stands, and since which start it is new."""

    def __init__(self, words: list[str]) -> None:
        self.split = [w.split() for w in words]

    @cached_property
    def number(self) -> dict[str, int]:
        """A number for each token; with it, the places of the page's tokens are laid out."""
        number: dict[str, int] = {}
        self.tokens = np.array([number.setdefault(t, len(number)) for w in self.split for t in w], np.int64)
        width = np.array([len(w) for w in self.split], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(width)])
        self.word = np.repeat(np.arange(len(width)), width)
        order = np.argsort(self.tokens, kind="stable")
        same = self.tokens[order][1:] == self.tokens[order][:-1]
        self.since = np.zeros(len(self.tokens), np.int64)  # runs from this word on don't hold the token's place before
        self.since[order[1:][same]] = self.word[order[:-1][same]] + 1
        self.member = np.zeros(len(number), bool)
        return number

    def best(self, tokens: list[str], cursor: int, floor: float, longest: int | None = None) -> tuple[int, int, float] | None:
        """(start, end, score) of the first and then shortest run from the cursor on with the highest score; None if no score is
        above 0 and at least floor. A score is the number of different tokens shared, by the larger number of different ones.
        Runs have 2 words less to 3 more than the text has tokens, and at most `longest` words if that is given. Starts are
        looked at block by block, up to the first run with a score of 1; only runs that hold enough tokens of the text are."""
        length, size = len(self.split), len(set(tokens))
        low, high = max(1, len(tokens) - 2), len(tokens) + 3
        if longest is not None:
            high = min(high, longest)
        if low > high:
            return None
        end = length - low + 1
        if not tokens or end <= cursor:
            return None
        if len(tokens) <= SHORT and floor <= 1 and (whole := self._whole(set(tokens), cursor, min(end, cursor + FIRST), low, high)):
            return whole
        known = [n for n in {self.number.get(t, -1) for t in tokens} if n >= 0]
        if not known:
            return None
        self.member[known] = True
        found, score, at, step = None, 0.0, cursor, FIRST
        while at < end and score < 1:
            stop = min(end, at + step)
            a, b = self.edges[at], self.edges[min(stop + high - 1, length)]
            hits = np.flatnonzero(self.member[self.tokens[a:b]]) + a
            where = self.word[hits]
            starts = np.arange(at, stop)
            inside = np.searchsorted(where, starts + high) - np.searchsorted(where, starts)  # hits of the longest run from each start
            bound = np.minimum(inside, len(known)) / size
            part = starts[(bound > score) & (bound >= floor)]
            if len(part):
                runs = np.arange(low, min(high, length - part[0]) + 1)
                each = self._scores(int(part[0]), int(part[-1]) + 1, runs, hits, size, max(score, floor))
                if each is not None:
                    top = each.max(0)
                    k = int(top.argmax())
                    if top[k] > score and top[k] >= floor:
                        start = int(part[0]) + k
                        found, score = (start, start + int(runs[each[:, k].argmax()]), float(top[k])), float(top[k])
            at, step = stop, min(MOST, 4 * step)
        self.member[known] = False
        return found

    def _whole(self, wanted: set[str], at: int, stop: int, low: int, high: int) -> tuple[int, int, float] | None:
        """The first and then shortest run with a score of 1 (all tokens, and no others) from a start in [at, stop)."""
        while at < stop:
            last = at
            while last < min(len(self.split), stop + high) and wanted.issuperset(self.split[last]):
                last += 1
            for start in range(at, min(last - low + 1, stop)):
                for n in range(low, min(high, last - start) + 1):
                    if len({t for w in self.split[start : start + n] for t in w}) == len(wanted):
                        return start, start + n, 1.0
            at = last + 1
        return None

    def _scores(self, a: int, b: int, runs: np.ndarray, hits: np.ndarray, size: int, least: float) -> np.ndarray | None:
        """Scores of the runs from each start in [a, b), by length; None if all are below least."""
        shared = self._different(a, b, runs, hits)
        if shared.max(initial=0) / size < least:
            return None
        every = np.arange(self.edges[a], self.edges[min(b - 1 + int(runs[-1]), len(self.edges) - 1)])
        score = shared / np.maximum(self._different(a, b, runs, every), size)
        score[np.arange(a, b) + runs[:, None] > len(self.edges) - 1] = 0
        return score

    def _different(self, a: int, b: int, runs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many different tokens of these places the runs from each start in [a, b) hold, by length: a place counts for the
        starts from which its word is reached and its token hasn't stood in the run before."""
        word = self.word[places]
        first = np.maximum(np.maximum(self.since[places], a), word - runs[:, None] + 1)
        last = np.minimum(word, b - 1)
        row, col = np.nonzero(first <= last)
        wide = b - a + 1
        cells = len(runs) * wide
        steps = np.bincount(row * wide + first[row, col] - a, minlength=cells) - np.bincount(row * wide + last[col] + 1 - a, minlength=cells)
        return steps.reshape(len(runs), wide).cumsum(1)[:, :-1]


def best_spans(floor: float, longest: int | None = None):
    """Each text of a page on its own. Rows: page_num, w (normalised words), texts (text_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, which, found = [], [], []
            ids = b.column(2).flatten().field("text_id") if b.num_rows else None
            for row in range(b.num_rows):
                index = PageIndex(b.column(1)[row].as_py() or [])
                for text in b.column(2)[row].as_py():
                    hit = index.best(text["tokens"], 0, 0.0, longest)
                    page.append(row)
                    found.append((-1, -1, 0.0) if hit is None else hit if hit[2] >= floor else (-1, -1, hit[2]))
            if page:
                which = [b.column(0).take(pa.array(page)), ids]
                start, end, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*which, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score)], ["page_num", "text_id", "start", "end", "score"])

    return run


MATCHES = "array<struct<field_no:int,label:string,matched:boolean,start:int,end:int,score:double>>"
_MATCHES = pa.list_(pa.struct([("field_no", pa.int32()), ("label", pa.string()), ("matched", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def matched_in_order(floor: float, outside: str):
    """A page's fields one behind another: each is looked for behind the one found before. Rows: page_num, w (normalised words),
    fields (field_no, label, tokens). The labels are the words'; those of no field have the label outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, size = b.column(2), [n or 0 for n in pc.list_value_length(b.column(2)).to_pylist()]
            tokens, kinds = fields.flatten().field("tokens").to_pylist(), fields.flatten().field("label").to_pylist()
            words, wide = b.column(1).flatten().to_pylist(), [n or 0 for n in pc.list_value_length(b.column(1)).to_pylist()]
            names = {outside: 0}
            codes, found = np.zeros(len(words), np.int64), []
            ends, edges = np.cumsum([0, *size]).tolist(), np.cumsum([0, *wide]).tolist()
            for row in range(b.num_rows):
                index, cursor = PageIndex(words[edges[row] : edges[row + 1]]), 0
                for k in range(ends[row], ends[row + 1]):
                    hit = index.best(tokens[k], cursor, floor)
                    if hit:
                        cursor = hit[1]
                        codes[edges[row] + hit[0] : edges[row] + cursor] = names.setdefault(kinds[k], len(names))
                    found.append((hit is not None, *(hit or (-1, -1, 0.0))))
            matched, start, end, score = zip(*found, strict=True) if found else ((), (), (), ())
            flat = fields.flatten()
            columns = [flat.field("field_no"), flat.field("label"), pa.array(matched, pa.bool_()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())]
            matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_MATCHES.value_type)))
            labels = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(list(names), pa.string()).take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([b.column(0), matches, labels], ["page_num", "matches", "labels"])

    return run


class FreeLines:
    """Lines (line_no, w: different words) of which the most alike free one is taken. Lines of equal words are one set, compared
    once, of which the first free line stands for all."""

    def __init__(self, lines: list[dict]) -> None:
        at: dict[frozenset, int] = {}
        self.queues: list[list[int]] = []
        self.of: dict[int, list[int]] = {}
        for line in sorted(lines, key=lambda x: x["line_no"]):
            k = at.setdefault(frozenset(line["w"] or ()), len(at))
            if k == len(self.queues):
                self.queues.append([])
            self.queues[k].append(line["line_no"])
            self.of.setdefault(line["line_no"], []).append(k)
        self.next = [0] * len(at)
        self.size = np.array([len(w) for w in at], np.int64)
        self.head = np.array([q[0] for q in self.queues], np.int64)
        holds: dict[str, list[int]] = {}
        for w, k in at.items():
            for x in w:
                holds.setdefault(x, []).append(k)
        self.holds = {x: np.array(ks, np.int64) for x, ks in holds.items()}
        self.free, self.taken = np.ones(len(at), bool), set()

    def best(self, words: frozenset) -> tuple[int, float] | None:
        """(line_no, likeness) of the free line with most words shared by the mean set size, the first of equals; None if no free
        line shares any. Two lines without words are alike."""
        if not len(self.size):
            return None
        if words:
            shared = np.zeros(len(self.size), np.int64)
            for x in words:
                if x in self.holds:
                    shared[self.holds[x]] += 1
            likeness = shared / ((self.size + len(words)) / 2)
        else:
            likeness = (self.size == 0).astype(float)
        likeness[~self.free] = 0
        most = likeness.max()
        if most <= 0:
            return None
        return int(self.head[self.free & (likeness == most)].min()), float(most)

    def take(self, line_no: int) -> None:
        self.taken.add(line_no)
        for k in self.of[line_no]:
            queue = self.queues[k]
            while self.next[k] < len(queue) and queue[self.next[k]] in self.taken:
                self.next[k] += 1
            self.free[k] = self.next[k] < len(queue)
            if self.free[k]:
                self.head[k] = queue[self.next[k]]


def paired_lines(same: float):
    """A page's lines a, in order, each with the free line of b that is most like it, then the lines of b that are left. Rows:
    page_num, a, b (line_no, w: different words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, rows = [], []
            for at in range(batch.num_rows):
                before = len(rows)
                lines = batch.column(2)[at].as_py() or []
                free = FreeLines(lines)
                for line in batch.column(1)[at].as_py() or []:
                    hit = free.best(frozenset(line["w"] or ()))
                    if hit is None:
                        rows.append((line["line_no"], None, "missing", 0.0))
                        continue
                    free.take(hit[0])
                    rows.append((line["line_no"], hit[0], "match" if hit[1] >= same else "mismatch", hit[1]))
                rows += [(None, x["line_no"], "extra", None) for x in lines if x["line_no"] not in free.taken]
                page += [at] * (len(rows) - before)
            if page:
                curated, found, status, likeness = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(page)), pa.array(curated, pa.int32()), pa.array(found, pa.int32()), pa.array(status), pa.array(likeness, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_num", "curated_no", "found_no", "status", "similarity"])

    return run
