"""Search for the next smaller number, over blocks that keep their least and greatest."""

from __future__ import annotations

import numpy as np


class RangeMinMax:
    """Least and greatest values of blocks of 2, 4, 8, ... numbers of a row."""

    def __init__(self, values: np.ndarray) -> None:
        self.size = len(values)
        self.least, self.greatest = [values], [values]
        while len(self.least[-1]) > 1:
            odd = len(self.least[-1]) % 2
            low = np.append(self.least[-1], self.least[-1][-1:]) if odd else self.least[-1]
            high = np.append(self.greatest[-1], self.greatest[-1][-1:]) if odd else self.greatest[-1]
            self.least.append(np.minimum(low[::2], low[1::2]))
            self.greatest.append(np.maximum(high[::2], high[1::2]))

    def first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each pair the first place from `start` on whose number is below `bound`; else the size.

        All searches climb over blocks without such a number, and then descend, together.
        """
        out = np.full(len(start), self.size, np.int64)
        lane = np.flatnonzero(start < self.size)
        place, level = start[lane].astype(np.int64), np.zeros(len(lane), np.int64)
        found_lane, found_place, found_level = [], [], []
        sizes = np.array([len(x) for x in self.least])
        first = np.cumsum(sizes) - sizes
        least = np.concatenate(self.least)
        while len(lane):
            hit = least[first[level] + place] < bound[lane]
            if hit.any():
                found_lane.append(lane[hit])
                found_place.append(place[hit])
                found_level.append(level[hit])
                lane, place, level = lane[~hit], place[~hit], level[~hit]
            place = place + 1
            inside = place < sizes[level]
            lane, place, level = lane[inside], place[inside], level[inside]
            up = (place % 2 == 0) & (level + 1 < len(sizes))
            place, level = np.where(up, place // 2, place), level + up
        if found_lane:
            lane, place, level = map(np.concatenate, (found_lane, found_place, found_level))
            while (level > 0).any():
                down = level > 0
                left = place * 2
                below = least[first[level - down] + np.where(down, left, place)] < bound[lane]
                place = np.where(down, np.where(below, left, left + 1), place)
                level = level - down
            out[lane] = place
        return out
