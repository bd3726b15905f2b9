"""Walks between stops as arrays, for tasks that look up many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most walks that one step lays out at once.
BLOCK = 2_000_000


def _key(period, stop):
    return pc.binary_join_element_wise(period.cast(pa.string()), stop.cast(pa.string()), "\0")


class WalkMap:
    """Walks by where they begin: rows (b, e, w) of numbered `begins` (period, stop_id) and `ends` (to_id)."""

    def __init__(self, begins: pa.Table, ends: pa.Table, walks: pa.Table):
        begin = walks["b"].to_numpy()
        order = np.argsort(begin, kind="stable")
        self.begins = _key(begins["period"], begins["stop_id"]).combine_chunks()
        self.ends = ends["to_id"].cast(pa.string()).combine_chunks()
        self.first = np.searchsorted(begin[order], np.arange(len(self.begins) + 1)).astype(np.int64)
        self.to = walks["e"].to_numpy()[order]
        self.w = walks["w"].to_numpy()[order]

    def reaching(self, labels: pa.Table, goals: pa.Table) -> pa.Table:
        """(label, to_id, w, stay) of the goals of its pair that a label stands at or can walk to."""
        valid = lambda t: t.filter(pc.and_(pc.is_valid(t["od_id"]), pc.is_valid(t["stop_id"])))
        labels, goals = valid(labels), valid(goals)
        pairs, stops = pc.unique(goals["od_id"]), pc.unique(goals["stop_id"])
        codes = lambda values, among: pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy().astype(np.int64)
        wide = len(stops) + 1
        asked = np.unique(codes(goals["od_id"], pairs) * wide + codes(goals["stop_id"], stops))
        pair, at = codes(labels["od_id"], pairs), codes(labels["stop_id"], stops)

        def known(pair, stop):
            key = np.where((pair < 0) | (stop < 0), -1, pair * wide + stop)
            place = np.minimum(np.searchsorted(asked, key), max(len(asked) - 1, 0))
            return asked[place] == key if len(asked) else np.zeros(len(key), bool)

        here = np.flatnonzero(known(pair, at))
        rows, found = [here], [labels["stop_id"].take(pa.array(here)).cast(pa.string())]
        far, stay = [np.full(len(here), np.nan)], [np.ones(len(here), bool)]
        begin = codes(_key(labels["period"], labels["stop_id"]), self.begins)
        begin[pair < 0] = -1
        ends = codes(self.ends, stops)
        many = np.where(begin < 0, 0, self.first[begin + 1] - self.first[begin])
        upto = np.concatenate([[0], np.cumsum(many)])
        i = 0
        while i < len(begin):
            j = max(int(np.searchsorted(upto, upto[i] + BLOCK, side="right")) - 1, i + 1)
            own = np.repeat(np.arange(i, j), many[i:j])
            walk = np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], many[i:j]) + self.first[begin[own]]
            hit = known(pair[own], ends[self.to[walk]])
            rows.append(own[hit])
            found.append(pa.chunked_array([self.ends.take(pa.array(self.to[walk[hit]])).cast(pa.string())]))
            far.append(self.w[walk[hit]])
            stay.append(np.zeros(int(hit.sum()), bool))
            i = j
        stay, far = np.concatenate(stay), np.concatenate(far)
        ids = pa.chunked_array([c for f in found for c in f.chunks], pa.string())
        return pa.table({
            "label": labels["label"].take(pa.array(np.concatenate(rows))), "to_id": ids,
            "w": pa.array(far, mask=stay | np.isnan(far)), "stay": pa.array(stay)})
