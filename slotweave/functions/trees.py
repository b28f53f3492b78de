"""The arithmetic of a random forest: bins, bootstrap weights, routes, counts, splits and votes.

Rows are held in chunks: a bin per row and column, a label, and the number of the row's device where the
model has a 0/1 column per device. A set of rows is one bit per row, so a row goes down all nodes of a tree
by a few operations on words of 64 rows. Nothing is kept per row and tree: weights are drawn anew from
(seed, tree, chunk) and nodes found anew in each pass. Runs inside Spark tasks. It needs numpy and Arrow
only, so it can be sent to the executors by value and they need no copy of this package.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

#: Rows of a chunk, and words of a row set that are worked on at a time (both sized for a core's cache).
CHUNK_ROWS = 65_536
BLOCK_WORDS = 1024
#: Columns are counted together while their bins come in at most so many combinations, of so many possible ones.
JOINT_CELLS = 256
JOINT_CODES = 1 << 20
#: Paths up to this length are looked up in a table of all of them.
TABLE_DEPTH = 16

#: A row's weight in a bootstrap sample is Poisson with mean 1: the number of these that a draw of 16 bits reaches.
_SHARES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
WEIGHT_CUTS = [np.uint16(cut) for cut in np.ceil(_SHARES * (1 << 16)).astype(int) if cut < 1 << 16]


def split_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between the distinct values, or, if they are too many, at about even shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[1:] + found[:-1]) / 2
    most = min(bins, len(values)) - 1
    if len(middles) <= most:
        return middles
    stride, reached = len(values) / (most + 1), np.cumsum(counts)
    points, target = [], stride
    for i in range(1, len(found)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            points.append(middles[i - 1])
            target += stride
    return np.array(points)


def joint_groups(widths, bins):
    """Columns that are counted together. ``bins``: those of some rows, by column; they only rule how columns are grouped.

    The hour of the week, for one, has no more values than it has together with the hour and the day.
    """
    groups = []
    for column in sorted(range(len(widths)), key=lambda c: -widths[c]):
        for group in groups:
            both = [*group, column]
            if math.prod(widths[c] for c in both) <= JOINT_CODES and len(np.unique(joint_code(bins, both, widths))) <= JOINT_CELLS:
                group.append(column)
                break
        else:
            groups.append([column])
    return groups


def joint_code(bins, group, widths):
    code = np.zeros(bins.shape[1], np.int64)
    for column in group:
        code *= widths[column]
        code += bins[column]
    return code


def occurring(batches, groups, widths, kind):
    """A flag per group and possible combination of bins: whether a row of these chunks has it."""
    seen = [np.zeros(math.prod(widths[c] for c in group), bool) for group in groups]
    for batch in batches:
        for row in batch.select(["rows", "bins"]).to_pylist():
            bins = np.frombuffer(row["bins"], kind).reshape(-1, row["rows"])
            for flags, group in zip(seen, groups):
                flags[joint_code(bins, group, widths)] = True
    for number, flags in enumerate(seen):
        values = [pa.array([number], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["item", "cells"])


def joint_cells(groups, widths, seen):
    """Per group its columns, the cell of each code, the number of cells and the bins of each; a last one has no columns.

    ``seen``: the packed flags of all tasks by group.
    """
    found = []
    for group, flags in zip(groups, seen):
        size = math.prod(widths[c] for c in group)
        every = np.bitwise_or.reduce([np.frombuffer(f, np.uint8) for f in flags], axis=0)
        codes = np.flatnonzero(np.unpackbits(every, count=size))
        cell = np.zeros(size, np.int32)
        cell[codes] = np.arange(len(codes))
        bins = np.array(np.unravel_index(codes, [widths[c] for c in group])).reshape(len(group), -1)
        found.append((group, cell, len(codes), bins))
    return [*found, ([], np.zeros(1, np.int32), 1, np.zeros((0, 1), int))]


def bin_type(bins: int) -> str:
    return "<u1" if bins <= 1 << 8 else "<u2" if bins <= 1 << 16 else "<u4"


CHUNK_TABLE = "part int, chunk int, rows int, bins binary, labels binary, devices binary"


def as_chunks(batches, columns, label, device, points, kind, part):
    """Arrow batches of rows as binned chunks, a row of ``CHUNK_TABLE`` each."""
    chunk, names = 0, [*columns, label] + ([device] if device else [])
    for table in _gathered((b.select(names) for b in batches), CHUNK_ROWS):
        binned = np.stack([np.searchsorted(p, _doubles(table, c)) for c, p in zip(columns, points)]) if columns else np.empty((0, table.num_rows))
        labels = _doubles(table, label)
        if (labels < 0).any() or (labels > 255).any() or (labels != labels.astype(int)).any():
            raise ValueError("labels must be whole numbers from 0 to 255")
        devices = table.column(device).to_numpy().astype("<i4").tobytes() if device else None
        row = [part, chunk, table.num_rows, binned.astype(kind).tobytes(), labels.astype("u1").tobytes(), devices]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names_out = ["part", "chunk", "rows", "bins", "labels", "devices"]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names_out)
        chunk += 1


def _gathered(batches, size):
    """The rows of the batches in tables of ``size`` rows; the last may be shorter."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            whole = pa.Table.from_batches(held)
            full = rows - rows % size
            for start in range(0, full, size):
                yield whole.slice(start, size).combine_chunks()
            held, rows = whole.slice(full).to_batches(), rows % size
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _doubles(table, name, null=None):
    column = table.column(name)
    if column.null_count:
        if null is None:
            raise ValueError(f"{name} is null in rows for the forest")
        column = column.fill_null(null)
    return column.cast(pa.float64()).to_numpy()


def row_sets(rows, columns, devices, features, cuts, flags):
    """Per block of words the sets of rows that go left at each split, and which set is that of which split.

    ``features, cuts``: the splits; features below ``flags`` are 0/1 columns of devices. Devices that none of the
    rows has share the set of all rows.
    """
    words = -(-rows // 64)
    there, order = np.flatnonzero(features >= flags), None
    if len(there) < len(features):
        wanted = np.flatnonzero(features < flags)
        order, start, end = rows_of_devices(devices, features[wanted])
        span = {int(g): (a, b) for g, a, b in zip(wanted, start, end) if a < b}
        there = np.array([*there, *span], np.int64)
    places = np.zeros(len(features), np.int64)
    places[there] = np.arange(1, len(there) + 1)
    sets = np.zeros((len(there) + 1, words * 8), np.uint8)
    sets[0] = 255
    # Plain numbers as cuts, so that columns of bytes are compared as bytes.
    features, cuts = features.tolist(), cuts.tolist()
    for i, g in enumerate(there.tolist(), 1):
        if features[g] >= flags:
            left = columns[features[g] - flags] <= cuts[g]
        else:
            left = np.full(rows, True)
            left[order[span[g][0] : span[g][1]]] = False
        sets[i, : -(-rows // 8)] = np.packbits(left, bitorder="little")
    sets = sets.view(np.uint64)
    return [np.ascontiguousarray(sets[:, a : a + BLOCK_WORDS]) for a in range(0, words, BLOCK_WORDS)], places


def rows_of_devices(devices, wanted):
    """An order of the rows in which those of the i-th wanted device are at ``start[i]`` to ``end[i]``."""
    order = np.argsort(devices, kind="stable")
    by_device = devices[order]
    return order, np.searchsorted(by_device, wanted), np.searchsorted(by_device, wanted, "right")


def paths(rows, sets, places, levels):
    """The path of each row down a tree, a bit per level, 1 to the right; 0 below a leaf.

    ``levels``: per level the splits of its nodes, and which of their children (left and right of the first,
    of the second ...) are the nodes of the next level.
    """
    kind = np.uint8 if len(levels) <= 8 else np.uint16 if len(levels) <= 16 else np.uint32
    found = np.zeros(-(-rows // 64) * 64, kind)
    levels = [(places[splits], keep) for splits, keep in levels]
    for block, some in enumerate(sets):
        width = some.shape[1]
        own = found[block * BLOCK_WORDS * 64 : (block * BLOCK_WORDS + width) * 64]
        nodes = np.full((1, width), ~np.uint64(0))
        for splits, keep in levels:
            sides = np.empty((len(splits), 2, width), np.uint64)
            np.bitwise_and(nodes, some.take(splits, axis=0), out=sides[:, 0])
            np.bitwise_xor(nodes, sides[:, 0], out=sides[:, 1])
            right = np.bitwise_or.reduce(sides[:, 1], axis=0)
            np.add(own, own, out=own)
            np.add(own, np.unpackbits(right.view(np.uint8), bitorder="little"), out=own)
            nodes = sides.reshape(-1, width)
            if len(keep) < len(nodes):
                nodes = nodes[keep]
    return found[:rows]


def nodes_of(path, wanted, depth):
    """The place of each path among the wanted ones, which are in order; for others their number."""
    if depth <= TABLE_DEPTH:
        table = np.full(1 << depth, len(wanted), np.int32)
        table[wanted] = np.arange(len(wanted))
        return table.take(path)
    node = np.searchsorted(wanted, path)
    return np.where(np.append(wanted, -1)[node] == path, node, len(wanted))


def weights(seed, tree, part, chunk, rows):
    draws = np.random.SFC64([seed, tree, part, chunk]).random_raw(-(-rows // 4)).view(np.uint16)[:rows]
    found = np.zeros(rows, np.uint8)
    for cut in WEIGHT_CUTS:
        found += draws >= cut
    return found.astype(np.float64)


def cells_of(job, item):
    """Where the counts of an item's groups end and those of its devices begin, and the end of these."""
    size = len(item["groups"]) * item["nodes"] * job["stride"]
    return size, size + len(item["pairs"][0]) * job["classes"]


COUNTED = "item int, cells binary"


def counted(batches, job):
    """Of each item (some nodes of one level of a tree) the weights by node, bins and label in this task's chunks."""
    sums = [np.zeros(cells_of(job, item)[1]) for item in job["items"]]
    flags, classes, stride = job["flags"], job["classes"], np.int64(job["stride"])
    needed = sorted({group for item in job["items"] for group in item["groups"]})
    for batch in batches:
        for row in batch.to_pylist():
            rows = row["rows"]
            columns = np.frombuffer(row["bins"], job["kind"]).reshape(-1, rows)
            labels = np.frombuffer(row["labels"], np.uint8)
            devices = np.frombuffer(row["devices"], "<i4") if flags else None
            sets, split_places = row_sets(rows, columns, devices, *job["splits"], flags)
            codes = {}
            for group in needed:
                together, cell, _, _ = job["joint"][group]
                codes[group] = cell.take(joint_code(columns, together, job["widths"])) * np.int64(classes) + labels
            base, code = np.empty(rows, np.int64), np.empty(rows, np.int64)
            if flags:
                every = np.unique(np.concatenate([item["pairs"][1] for item in job["items"]]))
                order, start, end = rows_of_devices(devices, every)
            for item, cells in zip(job["items"], sums):
                there = []
                if flags and len(item["pairs"][1]):
                    device = np.searchsorted(every, item["pairs"][1])
                    there = np.flatnonzero(start[device] < end[device])
                if not item["groups"] and not len(there):
                    continue
                path = paths(rows, sets, split_places, item["levels"])
                weight = weights(job["seed"], item["tree"], row["part"], row["chunk"], rows)
                node = path if item["paths"] is None else nodes_of(path, item["paths"], item["depth"])
                nodes = item["nodes"] + (item["paths"] is not None)
                size = item["nodes"] * job["stride"]
                np.multiply(node, stride, out=base, casting="unsafe")
                for i, group in enumerate(item["groups"]):
                    np.add(base, codes[group], out=code)
                    cells[i * size : (i + 1) * size] += np.bincount(code, weight, nodes * job["stride"])[:size]
                for pair in there:
                    own = order[start[device[pair]] : end[device[pair]]]
                    own = own[node[own] == item["pairs"][0][pair]]
                    a = len(item["groups"]) * size + pair * classes
                    cells[a : a + classes] += np.bincount(labels[own], weight[own], classes)
    for number, cells in enumerate(sums):
        if len(cells) and cells.max() >= 1 << 32:
            raise OverflowError("a task counts more rows than its cells hold")
        values = [pa.array([number], pa.int32()), pa.array([cells.astype("<u4").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["item", "cells"])


CHOSEN = "item int, features array<int>, cuts array<int>, gains array<double>, left array<double>, totals array<double>"


def chosen(batches, job):
    """The best split of each node, from the counts of all tasks: feature (-1: none), bin, gain and what goes left."""
    sums = {}
    for batch in batches:
        for number, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(cells.as_buffer(), "<u4")
            if number in sums:
                sums[number] += values
            else:
                sums[number] = values.astype(np.int64)
    for number, cells in sums.items():
        best = _best_splits(job, job["items"][number], cells)
        kinds = [pa.list_(pa.int32())] * 2 + [pa.list_(pa.float64())] * 3
        values = [pa.array([v.ravel()], k) for v, k in zip(best, kinds)]
        names = ["item", "features", "cuts", "gains", "left", "totals"]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *values], names)


def _gains(left, totals, least):
    """By how much splits lessen the Gini impurity; -1 where a side has fewer than ``least`` rows."""
    right = totals - left
    n, a, b = (x.sum(axis=-1).astype(np.float64) for x in (totals, left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        squares = (left.astype(float) ** 2).sum(axis=-1) / a + (right.astype(float) ** 2).sum(axis=-1) / b
        gains = (squares - (totals.astype(float) ** 2).sum(axis=-1) / n) / n
    return np.where((a >= least) & (b >= least) & (a > 0) & (b > 0), gains, -1.0)


def _best_splits(job, item, cells):
    classes, flags = job["classes"], job["flags"]
    nodes, totals = item["nodes"], item["totals"]
    groups, end = cells_of(job, item)
    by_group = cells[:groups].reshape(-1, nodes, job["stride"])
    if totals is None:
        totals = by_group[0].reshape(nodes, -1, classes).sum(axis=1)
    features, cuts = np.full(nodes, -1), np.zeros(nodes, np.int64)
    gains, left = np.zeros(nodes), np.zeros((nodes, classes))
    for group, counts in zip(item["groups"], by_group):
        columns, _, size, bins = job["joint"][group]
        counts = counts[:, : size * classes].reshape(nodes, size, classes).astype(np.float64)
        for column, own in zip(columns, bins):
            which = np.flatnonzero((item["chosen"] == flags + column).any(axis=1))
            width = job["widths"][column]
            if not len(which) or width < 2:
                continue
            upto = (own[:, None] <= np.arange(width - 1)).astype(np.float64)
            below = np.einsum("nsc,sb->nbc", counts[which], upto, optimize=True)
            gained = _gains(below, totals[which][:, None], job["least"])
            cut = gained.argmax(axis=1)
            here = gained[np.arange(len(which)), cut]
            better = here > gains[which]
            at = which[better]
            features[at], cuts[at], gains[at] = flags + column, cut[better], here[better]
            left[at] = below[better, cut[better]]
    if len(item["pairs"][0]):
        node, device = item["pairs"]
        below = totals[node] - cells[groups:end].reshape(-1, classes)
        gained = _gains(below, totals[node], job["least"])
        order = np.lexsort((gained, node))
        last = order[np.flatnonzero(np.append(node[order][1:] != node[order][:-1], True))]
        last = last[gained[last] > gains[node[last]]]
        at = node[last]
        features[at], cuts[at], gains[at], left[at] = device[last], 0, gained[last], below[last]
    return features, cuts, gains, left, totals


def leaf_votes(counts):
    """What each leaf says of each class."""
    return counts / counts.sum(axis=1, keepdims=True)


def scoring_plan(trees):
    """The splits of all trees, and per tree its levels and its leaves by path.

    ``trees``: per tree the feature (-1: leaf), threshold, left and right child and counts of its nodes.
    """
    splits, plans = {}, []
    for feature, threshold, left, right, counts in trees:
        votes = leaf_votes(np.asarray(counts, float))
        level, levels, leaves = [(0, 0)], [], []
        if feature[0] < 0:
            leaves, level = [(0, 0, 0)], []
        while level:
            ids, keep, below = [], [], []
            for at, (node, path) in enumerate(level):
                ids.append(splits.setdefault((int(feature[node]), float(threshold[node])), len(splits)))
                for side, child in enumerate((left[node], right[node])):
                    if feature[child] < 0:
                        leaves.append((len(levels) + 1, 2 * path + side, child))
                    else:
                        keep.append(2 * at + side)
                        below.append((child, 2 * path + side))
            levels.append((np.array(ids), np.array(keep, np.int64)))
            level = below
        ends = np.array([path << (len(levels) - depth) for depth, path, _ in leaves])
        said = votes[[node for *_, node in leaves]]
        order = np.argsort(ends)
        if len(levels) <= TABLE_DEPTH:
            table = np.zeros((1 << len(levels), said.shape[1]))
            table[ends] = said
            plans.append((levels, None, np.ascontiguousarray(table.T)))
        else:
            plans.append((levels, ends[order], np.ascontiguousarray(said[order].T)))
    pairs = np.array(list(splits), float).reshape(-1, 2)
    return pairs[:, 0].astype(np.int64), pairs[:, 1], plans


def scored(batches, plan, columns, device, flags):
    """The rows with the class of most votes, of equal ones the first, and the share of votes for class 1."""
    features, cuts, plans = plan
    for table in _gathered(batches, CHUNK_ROWS):
        rows = table.num_rows
        values = [_doubles(table, c, 0.0 if flags else None) for c in columns]
        if not flags and any(np.isnan(v).any() for v in values):
            raise ValueError("a column of the forest is not a number")
        devices = _doubles(table, device, -1).astype(np.int64) if device else None
        sets, places = row_sets(rows, values, devices, features, cuts, flags)
        classes = plans[0][2].shape[0]
        votes = np.zeros((classes, rows))
        for levels, ends, said in plans:
            path = paths(rows, sets, places, levels)
            leaf = path if ends is None else np.searchsorted(ends, path)
            # A tree has one vote, so the first class has what is left.
            for k in range(1, classes):
                votes[k] += said[k].take(leaf)
        votes[0] = len(plans) - votes[1:].sum(axis=0)
        # Sums of shares are exact up to rounding, which must not decide between equal votes.
        winner = np.round(votes, 9).argmax(axis=0).astype(np.int32)
        if device:
            table = table.drop_columns([device])
        found = table.append_column("activation_predicted", pa.array(winner))
        yield from found.append_column("activation_probability", pa.array(votes[1] / len(plans))).to_batches()
