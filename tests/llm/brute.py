"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict


def words(text):
    return text.encode().lower().split() if text else []


class Katz:
    """Dictionary version of the backoff model, with recursive probabilities."""

    def __init__(self, docs, order, k=5, delta=0.1):
        self.order, self.k, self.delta = order, k, delta
        self.c = {n: Counter() for n in range(1, order + 1)}
        self.ctx = defaultdict(int)
        self.follow = defaultdict(set)
        for doc_id, text in docs:
            if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0:
                continue
            t = [b"\n<s>"] * (order - 1) + words(text) + [b"\n</s>"]
            for i in range(order - 1, len(t)):
                for n in range(1, order + 1):
                    g = tuple(t[i - n + 1:i + 1])
                    self.c[n][g] += 1
                    self.ctx[n, g[:-1]] += 1
                    self.follow[n, g[:-1]].add(g[-1])
        self.total = sum(self.c[1].values())
        self.d = {n: self.discounts(n) for n in self.c}
        free = self.total - sum(self.less(1, x) for x in self.c[1].values())
        self.free = free / self.total if self.total else 1.0

    def discounts(self, n):
        coc = Counter(self.c[n].values())
        k, d = self.k, {}
        try:
            last = (k + 1) * coc[k + 1] / coc[1]
            for r in range(1, k + 1):
                d[r] = ((r + 1) * coc[r + 1] / (r * coc[r]) - last) / (1 - last)
            good = all(0 < x < 1 for x in d.values())
        except ZeroDivisionError:
            good = False
        if not good:
            gap = coc[1] / (coc[1] + 2 * coc[2]) if coc[1] and coc[2] else 0.5
            d = {r: (r - gap) / r for r in range(1, k + 1)}
        return d

    def less(self, n, count):
        return count - self.delta if count > self.k else self.d[n][count] * count

    def p(self, n, h, w):
        """P(w | h) with a context of n - 1 words."""
        g = h[len(h) - n + 1:] + (w,) if n > 1 else (w,)
        count = self.c[n][g]
        if n == 1:
            return self.less(1, count) / self.total if count else self.free
        if count:
            return self.less(n, count) / self.ctx[n, g[:-1]]
        return self.alpha(n, g[:-1]) * self.p(n - 1, h, w)

    def alpha(self, n, h):
        seen = self.follow.get((n, h))
        if not seen:
            return 1.0
        return (1 - sum(self.less(n, self.c[n][h + (w,)]) / self.ctx[n, h] for w in seen)) / (1 - sum(self.p(n - 1, h, w) for w in seen))

    def score(self, text):
        t = [b"\n<s>"] * (self.order - 1) + words(text) + [b"\n</s>"]
        m = self.order - 1
        return sum(math.log10(self.p(self.order, tuple(t[i - m:i]) if m else (), t[i])) for i in range(m, len(t)))

    def base(self, text):
        v = len(self.c[1])
        return sum(math.log10((self.c[1][(w,)] + 0.1) / (self.total + 0.1 * (v + 1))) for w in words(text) + [b"\n</s>"])

    def known(self, text):
        return sum(self.c[1][(w,)] > 0 for w in words(text) + [b"\n</s>"])
