"""Order-dependent operators, one group at a time: alignment by dynamic programming, greedy batching and matching,
text cutting, box merging, state machines. A group is a document, a page, a conversation or a job: bounded by nature.

Plain functions do the work on lists, so they can be used and tested without a session; :func:`per_group` applies one
to the groups of a table, which are read in order of the given columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

TINY = 1e-9


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Rows (without the keys) that ``work`` makes of each group sorted by ``order``; the keys come first.

    Groups are dealt by key and sorted by Spark (which spills), then streamed: many small groups share a batch, and only
    one group at a time is held beyond a batch."""
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def made(groups: list[pd.DataFrame]) -> pd.DataFrame:
            rows = []
            for g in groups:
                head = tuple(g[k].iloc[0] for k in keys)
                rows += [(*head, *r) for r in work(g)]
            return pd.DataFrame(rows, columns=[*keys, *fields])

        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            same = pdf[keys].eq(pdf[keys].shift()) | (pdf[keys].isna() & pdf[keys].shift().isna())
            starts = (~same.all(axis=1)).to_numpy().nonzero()[0].tolist()
            starts = starts if starts and starts[0] == 0 else [0, *starts]
            yield made([pdf.iloc[a:b] for a, b in zip(starts, starts[1:])])
            held = pdf.iloc[starts[-1] :]
        if held is not None and len(held):
            yield made([held])

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, f"{kinds}, {schema}")


def per_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], work: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """As :func:`per_group` for many small groups: ``work`` gets the values of ``columns``, a list each, and only these
    reach Python; missing floating-point numbers are NaN. Groups are cut out of lists, a batch's columns made once."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    keys, columns = list(keys), list(columns)
    fields = df.sparkSession.createDataFrame([], schema).schema
    names, types = [*keys, *fields.names], [f.type for f in to_arrow_schema(fields)]

    def values(c: pa.Array) -> list:
        return (pc.fill_null(c, float("nan")) if pa.types.is_floating(c.type) else c).to_pylist()

    def made(table: pa.Table, starts: list[int], ends: list[int]) -> pa.RecordBatch:
        lists, at, rows = [values(table.column(c)) for c in columns], [], []
        for a, b in zip(starts, ends, strict=True):
            some = work(*[x[a:b] for x in lists])
            at += [a] * len(some)
            rows += some
        cells = list(zip(*rows, strict=True)) or [[] for _ in types]
        heads = [table.column(k).combine_chunks().take(pa.array(at, pa.int64())) for k in keys]
        return pa.RecordBatch.from_arrays([*heads, *(pa.array(list(c), t) for c, t in zip(cells, types, strict=True))], names=names)

    def changes(b: pa.RecordBatch) -> list[int]:
        """Places of rows whose keys aren't those of the row before."""
        out = np.zeros(len(b) - 1, bool)
        for k in keys:
            x, y = b.column(k).slice(1), b.column(k).slice(0, len(b) - 1)
            out |= pc.fill_null(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
        return (out.nonzero()[0] + 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last group, which may go on
        for batch in batches:
            if not len(batch):
                continue
            first = [0] if held and changes(pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)]).select(keys).combine_chunks().to_batches()[0]) else []
            starts = [*first, *changes(batch)]
            if not starts:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            before = sum(map(len, held))
            places = [x + before for x in starts]
            places = [0, *places] if places[0] else places
            yield made(table, places[:-1], places[1:])
            held = [batch.slice(starts[-1])]
        if held:
            yield made(pa.Table.from_batches(held), [0], [sum(map(len, held))])

    dealt = df.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*dict.fromkeys([*keys, *columns])).mapInArrow(run, f"{kinds}, {schema}")


def per_row(df: DataFrame, keep: Sequence[str], work: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that ``work`` makes of the other columns' values of each row, ``keep`` coming first: a map, no row is moved and
    repeated or null keys change nothing."""
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    rest = [c for c in df.columns if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            for i, values in enumerate(zip(*(b.column(c).to_pylist() for c in rest), strict=True)):
                rows = work(*values)
                at += [i] * len(rows)
                made += rows
            columns = list(zip(*made, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in keep), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=[*keep, *fields])

    types = [f.type for f in to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)]
    return df.select(*keep, *rest).mapInArrow(run, f"{kinds}, {schema}")


# -- alignment ------------------------------------------------------------------------------------------------------


def align(left: int, right: int, score: Callable[[int, int], float], penalty: float = 0.85) -> list[tuple[list[int], list[int], float]]:
    """Best monotone alignment of two sequences by 1:1, 2:1, 1:2, 1:0 and 0:1 steps.

    A pair earns its score (0 to 1); a double step earns both scores less the penalty, a step of one side loses it. Of
    equal sums the step tried first stays, in the order given. Units are (left places, right places, mean score)."""
    s = [[min(1.0, max(0.0, score(i, j) or 0.0)) for j in range(right)] for i in range(left)]
    best = {(0, 0): (0.0, None)}
    steps = ((1, 1), (2, 1), (1, 2), (1, 0), (0, 1))
    for i in range(left + 1):
        for j in range(right + 1):
            here = best[i, j][0]
            for a, b in steps:
                if i + a > left or j + b > right:
                    continue
                if a and b:
                    gain = sum(s[i + p][j + q] for p in range(a) for q in range(b)) - (penalty + 1e-6 if a + b > 2 else 0.0)
                else:
                    gain = -penalty
                if (i + a, j + b) not in best or here + gain > best[i + a, j + b][0] + TINY:
                    best[i + a, j + b] = here + gain, (a, b)
    units = []
    i, j = left, right
    while i or j:
        a, b = best[i, j][1]
        ls, rs = list(range(i - a, i)), list(range(j - b, j))
        pairs = [s[p][q] for p in ls for q in rs]
        units.append((ls, rs, sum(pairs) / len(pairs) if pairs else 0.0))
        i, j = i - a, j - b
    return units[::-1]


def mean_confidence(units) -> float:
    matched = [c for ls, rs, c in units if ls and rs]
    return sum(matched) / len(matched) if matched else 0.0


def overlap_score(a: str, b: str) -> float:
    """Shared words over the smaller set; the default pair score."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def align_blocks(left: list[str], right: list[str], score=overlap_score, least: float = 0.35) -> tuple[str, list]:
    """Sentence level, or one unit of everything where the mean confidence is under ``least`` or a side is empty."""
    units = align(len(left), len(right), lambda i, j: score(left[i], right[j]))
    if not left or not right or mean_confidence(units) < least:
        return "paragraph", [(list(range(len(left))), list(range(len(right))), mean_confidence(units))]
    return "sentence", units


def anchored(left: list[tuple[str | None, str]], right: list[tuple[str | None, str]], score=overlap_score, penalty: float = 0.8) -> list[tuple[list[int], list[int], float]]:
    """Blocks (anchor label or None, text): equal labels are paired in order first, blocks between are aligned."""
    used, pairs = set(), []
    for i, (label, _) in enumerate(left):
        if label is not None:
            j = next((j for j, (other, _) in enumerate(right) if other == label and j not in used), None)
            if j is not None:
                used.add(j)
                pairs.append((i, j))
    kept, top = [], -1
    for i, j in pairs:  # an anchor that would cross an earlier one is left to alignment
        if j > top:
            kept.append((i, j))
            top = j
    out, a, b = [], 0, 0
    for i, j in [*kept, (len(left), len(right))]:
        for ls, rs, c in align(i - a, j - b, lambda p, q, a=a, b=b: score(left[a + p][1], right[b + q][1]), penalty):
            out.append(([a + p for p in ls], [b + q for q in rs], c))
        if i < len(left):
            out.append(([i], [j], 1.0))
        a, b = i + 1, j + 1
    return out


def approximate_range(words: list[str], needle: list[str], start: int = 0) -> tuple[int, int, float] | None:
    """(first, end, confidence) of the words closest to the needle by edits, anywhere from ``start``; confidence is
    1 - edits / length, 0.82 at least and 0.95 at most; none for needles under 4 words or twice the words there are."""
    n = len(needle)
    if n < 4 or 2 * (len(words) - start) < n:
        return None
    most = next((k for k in range(n, -1, -1) if 1 - k / n >= 0.82), 0)  # edits that count
    best = None
    for a, b in _windows(words, needle, start, most):
        best = _closest(words, needle, a, b, best or (most + 1, 0, 0))
        if not best[0]:
            break
    return (best[1], best[2], min(0.95, 1 - best[0] / n)) if best and best[0] <= most else None


def _windows(words: list[str], needle: list[str], start: int, most: int) -> list[tuple[int, int]]:
    """Where the needle may be with at most ``most`` edits: of its most + 1 pieces one is there as it is, and all that
    such a match may span lies around. Windows are in order and don't overlap."""
    n, found = len(needle), []
    cuts = [k * n // (most + 1) for k in range(most + 2)]
    for a, b in zip(cuts, cuts[1:]):
        piece = needle[a:b]
        rare = min(range(b - a), key=lambda k: words.count(piece[k]))
        at = start + rare - 1
        while True:
            try:
                at = words.index(piece[rare], at + 1)
            except ValueError:
                break
            first = at - rare
            if words[first : first + b - a] == piece:
                found.append((max(start, first - a - 2 * most), min(len(words), first - a + n + 2 * most)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _closest(words: list[str], needle: list[str], start: int, end: int, best: tuple[int, int, int]) -> tuple[int, int, int]:
    """(edits, first, end) of the words from ``start`` to ``end`` that are closest to the needle, the first of equals, or
    ``best`` where none has fewer edits."""
    n = len(needle)
    row = [(i, start) for i in range(n + 1)]
    for at in range(start, end):
        diagonal, row[0] = row[0], (0, at + 1)
        for i in range(1, n + 1):
            cost = diagonal[0] + (needle[i - 1] != words[at])
            found = min((cost, diagonal[1]), (row[i][0] + 1, row[i][1]), (row[i - 1][0] + 1, row[i - 1][1]), key=lambda x: x[0])
            diagonal, row[i] = row[i], found
        if row[n][0] < best[0]:
            best = row[n][0], row[n][1], at + 1
    return best


def cursor_matches(text: str, needles: list[str]) -> list[tuple[int, int, bool]]:
    """Each needle is looked for after the end of the last one found; a miss leaves the cursor."""
    out, cursor = [], 0
    for needle in needles:
        at = text.find(needle, cursor) if needle else -1
        out.append((at, at + len(needle) if at >= 0 else -1, at >= 0))
        if at >= 0:
            cursor = at + len(needle)
    return out


# -- greedy choices -------------------------------------------------------------------------------------------------


def batches(tokens: list[int], shared: int = 0, most_tokens: int = 4000, most_blocks: int = 8) -> list[tuple[int, int, bool]]:
    """(batch, tokens of the batch, oversized) of each block in order. Every batch pays the shared tokens once; a block
    too large by itself is a batch of its own."""
    out, start, used, number = [], 0, shared, 1
    done: list[tuple[int, int, bool]] = []

    def flush(end: int):
        nonlocal start, used, number
        if end > start:
            done.extend([(number, used, False)] * (end - start))
            number += 1
        start, used = end, shared

    for i, t in enumerate(tokens):
        if i - start >= most_blocks:
            flush(i)
        if shared + t > most_tokens:
            flush(i)
            done.append((number, shared + t, True))
            number += 1
            start = i + 1
            continue
        if i > start and used + t > most_tokens:
            flush(i)
        used += t
    flush(len(tokens))
    out.extend(done)
    return out


def one_to_one(links: list[tuple]) -> list[tuple]:
    """Links (left, right, ...) in order of preference; each end is used once."""
    left, right, out = set(), set(), []
    for link in links:
        if link[0] not in left and link[1] not in right:
            left.add(link[0])
            right.add(link[1])
            out.append(link)
    return out


def throttle(rows: list[tuple[str, float]], gap: float = 2.0) -> list[bool]:
    """Keep (phase, seconds) unless the last kept row is of the same phase and under ``gap`` seconds old."""
    out, last = [], None
    for phase, at in rows:
        keep = last is None or last[0] != phase or at - last[1] >= gap
        out.append(keep)
        if keep:
            last = phase, at
    return out


# -- texts ----------------------------------------------------------------------------------------------------------


def cut_text(text: str, most: int = 1800, least_share: float = 0.5, marks: str = "\n\n|(?<=[.!?。！？])\\s") -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last mark after ``least_share`` of the room, or else hard. Null
    is an empty text."""
    text, out = text or "", []
    while len(text) > most:
        ends = [m.end() for m in re.finditer(marks, text[:most]) if m.end() >= most * least_share]
        end = ends[-1] if ends else most
        out.append(text[:end])
        text = text[end:]
    return [*out, text] if text or not out else out


def mask_tokens(text: str, pattern: str, block: int) -> tuple[str, list[tuple[str, str]]]:
    """Protected tokens replaced by numbered markers, and what each marker stands for. Null is an empty text."""
    text, found = text or "", []

    def one(m: re.Match) -> str:
        found.append((f"⟦PP{block}_{len(found)}⟧", m[0]))
        return found[-1][0]

    return re.sub(pattern, one, text), found


def restore_tokens(text: str, found: list[tuple[str, str]]) -> str:
    """Markers back to tokens; a token whose marker is missing goes before the final mark."""
    for marker, token in found:
        if marker in text:
            text = text.replace(marker, token, 1)
        else:
            m = re.search(r"[。！？.!?]?\s*$", text)
            text = f"{text[: m.start()]} {token}{text[m.start() :]}"
    return text


def first_json(raw: str) -> str | None:
    """The first balanced object in a text, braces in strings left alone."""
    start = raw.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(max(start, 0), len(raw)) if start >= 0 else ():
        c = raw[i]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return raw[start : i + 1]
    return None


def paginate(heights: list[float], page: float = 700.0, columns: int = 2) -> list[tuple[int, int, float]]:
    """(page, column, y) of blocks in order: down a column, then the next column, then the next page; a block higher
    than a page stands alone at the top of one."""
    out, at, column, y = [], 0, 0, 0.0
    for h in heights:
        if y > 0 and y + h > page:
            column, y = column + 1, 0.0
            if column == columns:
                at, column = at + 1, 0
        out.append((at, column, y))
        y += h
    return out


# -- boxes ----------------------------------------------------------------------------------------------------------

Box = tuple[float, float, float, float]


def near(a: Box, b: Box, gap: float) -> bool:
    return a[0] <= b[0] + b[2] + gap and b[0] <= a[0] + a[2] + gap and a[1] <= b[1] + b[3] + gap and b[1] <= a[1] + a[3] + gap


def area(a: Box, b: Box) -> float:
    return max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def merge_boxes(boxes: list[Box], gap: float = 6.0, least_area: float = 1600.0) -> list[Box]:
    """Boxes that overlap or are near grow together until none does; small ones go."""
    todo = list(boxes)
    changed = True
    while changed:
        changed, out = False, []
        for b in todo:
            k = next((k for k, o in enumerate(out) if near(o, b, gap)), None)
            if k is None:
                out.append(b)
            else:
                o = out[k]
                x, y = min(o[0], b[0]), min(o[1], b[1])
                out[k] = x, y, max(o[0] + o[2], b[0] + b[2]) - x, max(o[1] + o[3], b[1] + b[3]) - y
                changed = True
        todo = out
    return [b for b in todo if b[2] * b[3] >= least_area]


def dedup_boxes(boxes: list[tuple[Box, bool]], contained: float = 0.8) -> list[int]:
    """Places of the (box, captioned) that stay: of two, one of which holds ``contained`` of the other, the captioned
    and then the larger one."""
    kept: list[int] = []
    held: list[tuple] = []  # of those kept: left, top, right, bottom, size, captioned
    for i, ((x, y, w, h), captioned) in enumerate(boxes):
        right, bottom, size = x + w, y + h, w * h
        for k, (left, top, end, low, other, had) in enumerate(held):
            both = max(0.0, min(right, end) - max(x, left)) * max(0.0, min(bottom, low) - max(y, top))
            if both >= contained * max(TINY, min(size, other)):
                if (captioned, size) > (had, other):
                    kept[k], held[k] = i, (x, y, right, bottom, size, captioned)
                break
        else:
            kept.append(i)
            held.append((x, y, right, bottom, size, captioned))
    return kept


def text_rows(words: list[tuple[float, float, float, str]]) -> list[str]:
    """Words (x, y, height, text) to lines: a word joins the latest row whose top is within max(2, 0.35 height)."""
    rows: list[tuple[float, list]] = []
    for x, y, h, text in sorted(words, key=lambda w: (w[1], w[0])):
        row = next((r for r in reversed(rows) if abs(r[0] - y) < max(2.0, 0.35 * h)), None)
        if row is None:
            rows.append((y, [(x, text)]))
        else:
            row[1].append((x, text))
    return [" ".join(t for _, t in sorted(r[1], key=lambda w: w[0])) for r in rows]


# -- states ---------------------------------------------------------------------------------------------------------

#: event -> (stage, least progress or None to keep it); RETRY starts again
JOB_EVENTS = {"START": ("parsing", 5), "PARSED": ("analyzing", 40), "ANALYZED": ("indexing", 80), "INDEXED": ("completed", 100), "PAUSE": ("paused", None), "RESUME": ("queued", None), "FAIL": ("failed", None), "RETRY": ("queued", 0)}
ACTIVE = ("parsing", "analyzing", "indexing")


def fold_job(events: list[str], stage: str = "queued", progress: int = 0, attempts: int = 0) -> list[tuple[str, int, int]]:
    """(stage, progress, attempts) after each event; progress never falls but by RETRY."""
    out = []
    for e in events:
        if e in JOB_EVENTS:
            stage, least = JOB_EVENTS[e]
            if e == "RETRY":
                progress, attempts = 0, attempts + 1
            elif least is not None:
                progress = max(least, progress)
        out.append((stage, progress, attempts))
    return out


#: event -> (stages or None for any, statuses or None, next stage or None, next status or None)
TASK_EVENTS = {
    "START_PARSE": (("idle",), None, "parsing", "running"), "PARSE_DONE": (("parsing",), None, "analyzing-layout", None), "LAYOUT_DONE": (("analyzing-layout",), None, "building-glossary", None),
    "GLOSSARY_DONE": (("building-glossary",), None, "translating", None), "START_TRANSLATION": (None, None, "translating", "running"), "TRANSLATION_DONE": (("translating",), None, "composing", None),
    "COMPOSITION_DONE": (("composing",), None, "compiling", None), "COMPILE_DONE": (("compiling",), None, "aligning", None), "ALIGNMENT_DONE": (("aligning",), None, None, None), "QUALITY_STARTED": (("aligning",), None, "validating", None),
    "PAUSED": (None, ("running", "pausing"), None, "paused"), "STOP_REQUESTED": (None, ("running",), None, "stopping"), "STOPPED": (None, ("stopping",), None, "stopped"), "INTERRUPTED": (None, ("running", "stopping", "pausing"), None, "stopped"),
    "RESUME": (None, ("stopped", "paused", "failed"), None, "running"), "FAILED": (None, None, None, "failed"), "QUALITY_PASSED": (("validating",), None, "completed", "completed"),
}


def fold_task(events: list[tuple[str, int]]) -> list[tuple[str, str, int, int, bool]]:
    """(stage, status, completed, total, legal) after each (event, count); an illegal event changes nothing."""
    stage, status, completed, total = "idle", "idle", 0, 0
    out = []
    for name, count in events:
        legal = False
        if name == "BLOCKS_VALIDATED":
            legal = stage == "translating" and completed + count <= total
            completed += count if legal else 0
        elif name in TASK_EVENTS:
            stages, statuses, to, becomes = TASK_EVENTS[name]
            legal = (stages is None or stage in stages) and (statuses is None or status in statuses) and (name != "TRANSLATION_DONE" or completed == total)
            if legal:
                stage, status = to or stage, becomes or status
                if name == "START_TRANSLATION":
                    completed, total = 0, count
        out.append((stage, status, completed, total, legal))
    return out
