"""The fold stated sequentially, for comparison."""


def merge(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def clip(spans, hole):
    out = []
    for s, e in spans:
        if hole[1] < s or hole[0] > e:
            out.append((s, e))
            continue
        if s < hole[0]:
            out.append((s, hole[0] - 1))
        if e > hole[1]:
            out.append((hole[1] + 1, e))
    return out


def held(rows):
    """{statement: intervals} of rows (statement, polarity, start, end)."""
    out = {}
    for sid in {r[0] for r in rows}:
        spans = merge([(s, e) for i, p, s, e in rows if i == sid and p > 0])
        for i, p, s, e in rows:
            if i == sid and p < 0:
                spans = clip(spans, (s, e))
        if spans:
            out[sid] = spans
    return out


def supersede(spans):
    """[(statement, start, end, status)] by the rule stated row by row."""
    rows = sorted((s, i, e) for i, own in spans.items() for s, e in own)
    out = []
    for s, i, e in rows:
        status = "active"
        if out and out[-1][0] != i:
            p = out[-1]
            if p[1] == s:
                status = "contradicted"
                p[3] = "contradicted"
            elif p[3] == "active" and p[2] >= s:
                p[2], p[3] = s - 1, "superseded"
        out.append([i, s, e, status])
    return sorted(map(tuple, out))


def contradict(spans):
    bad = {i for i, own in spans.items() for j, other in spans.items() if i != j for a in own for b in other if a[0] <= b[1] and b[0] <= a[1]}
    return sorted((i, s, e, "contradicted" if i in bad else "active") for i, own in spans.items() for s, e in own)
