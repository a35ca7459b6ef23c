"""Plain-Python statements of what the operators must return."""

import re


def components(nodes, linked):
    """{node: smallest node reachable}; ``linked(a, b)`` over all pairs."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def secret_spans(t):
    out, t = [], t or ""
    key = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(key, t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += x * 2 - 9 * (x > 4) if i % 2 else x
    return total % 10 == 0


def personal_spans(t):
    out, t = [], t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def edit_distance_within(item, text):
    """Least edits between ``item`` and any stretch of ``text`` (lists of words)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
