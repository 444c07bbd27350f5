"""Plain Python twins of the operators, for small inputs."""

import hashlib
import re

BASE_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
BASE_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def accepted(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(x) <= 255 for x in m[0].split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "assign":
        return len(m[2]) >= 6
    return len(m[0]) >= {"access": 20, "hex": 24}.get(kind, 0)


def base(text, rules):
    """Counts by kind, and the joined spans, of the base patterns."""
    found = []
    for rank, (kind, pattern) in enumerate(rules):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", re.A) if accepted(kind, m)]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return [sum(k == kind for _, _, k, _ in found) for kind, _ in rules], joined


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kmers(text, width=5):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return []
    seen, out = {}, []
    for k in range(max(len(words) - width + 1, 1)):
        gram = tuple(words[k : k + width])
        seen[gram] = seen.get(gram, 0) + 1
        out.append((gram, seen[gram]))
    return out


def aligned(a, b):
    """Longest common subsequence of two k-mer sequences over their distinct k-mers."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0
