"""Plain versions of conversation repair and the manifest: no runs, no blocks, no logs."""

import hashlib
import heapq
import re
import zlib

NEXT_ROLE = {"": "u", "s": "u", "u": "a", "a": "u"}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, a = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if a == 0:
            continue
        text = "" if a == 1 else re.sub("[.!?]", "", text) if a == 2 else text
        out += [(conv, turn, "user" if a == 4 else role, text)] * (2 if a == 3 else 1)
    return out


def allowed(before, initial):
    return initial == "s" and before == "" or initial == "u" and before in ("", "s", "a") or initial == "a" and before == "u"


def cheapest(rows, faults):
    """Least (cost, audit) by a best-first search over (row, last role), strings compared in full."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT_ROLE[last]))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
        if faults[i] not in ("blank", "duplicate"):
            extra = faults[i] == "truncated"
            if allowed(last, rows[i][2][:1]):
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, rows[i][2][:1]))
            heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, NEXT_ROLE[last]))


def repair_one(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for r in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", r[3])
        faults.append("blank" if not kept else "duplicate" if r[2:] in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add(r[2:])
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit = cheapest(rows, faults)
    lines, last, i = [], "", 0
    names = {"u": "user", "a": "assistant"}
    for e in audit:
        if e == "K":
            lines.append(f"{rows[i][2]}:{rows[i][3]}")
            last = rows[i][2][:1]
        elif e in "IR":
            last = NEXT_ROLE[last]
            lines.append(f"{names[last]}:{'' if e == 'I' else rows[i][3]}")
        i += e != "I"
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))


def repair(rows, broken=None):
    broken = damage(rows) if broken is None else broken
    groups = {r[0]: [] for r in rows}
    for r in broken:
        groups[r[0]].append(r)
    return {c: repair_one(g) if g else (0, 0, 0, 0, 0, 0, "", sha("")) for c, g in groups.items()}


def manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
            i >>= 1
        return out

    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4]) if hit else r)
            for odd, s in steps:
                node = sha(node) if s is None else sha(s, node) if odd else sha(node, s)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[s for _, s in steps if s]), node, node == top[-1][0]))
    return out
