"""Plain versions of what the classifiers compute, for the tests alone."""

import math
import re
from collections import Counter


def quality_statistics(text):
    data, blanks = text.encode(), b" \t\n\x0b\x0c\r"
    words, size = data.split(), len(data)
    if not words:
        return [float(size)] + [0.0] * 24
    n = len(words)
    share = lambda test: sum(1 for b in data if test(b)) / size
    among = lambda chars: share(lambda b: b in chars)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        size, n, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), among(b"!$#%&*|.,:;<>@/=+-_\"'()[]{}"), among(blanks), len(lines) / n,
        share(lambda b: b >= 128), among(b"!"), among(b"|"), among(b"$#%&"), among(b"*"), among(b"."), among(b"<>"), among(b"@"),
        sum(1 for b in data if b not in blanks) / n, sum(len(w) > 15 for w in words) / n, len(set(words)) / n, max(Counter(words).values()) / n,
        sum(words[k] == words[k + 1] for k in range(n - 1)) / n, sum(w[-1:] in [bytes([c]) for c in b"!$#%&*|"] for w in words) / n,
        sum(w[:1].isalpha() and w[:1].isupper() for w in words) / n, sum(w.isupper() for w in words) / n, 1 - len(set(lines)) / len(lines),
        max(sum(b in b"|$!" for b in x) / max(1, len(x)) for x in data.split(b"\n")),
    ]


def quality_score(model, text):
    own = quality_statistics(text)
    margin = model.bias
    for rule, weight in zip(model.rules, model.weights, strict=True):
        if all((own[k] > cut) == above for k, cut, above in rule):
            margin += weight
    return 1 / (1 + math.exp(-margin))


def toxic_votes(t, mined, text):
    low = text.lower()
    words = set(re.findall(r"[^\W\d_]+", low))
    held = lambda s, level: sum(w.startswith(s) if len(s) >= t.SHORTEST else w == s for w in words) >= level
    out = [any(held(s, 1) for s in x.split()) for x in t.LEXICONS.values()]
    out += [held(s.split("@")[0], int(s.split("@")[1])) for s in mined]
    return out + [re.search(p, low) is not None for p in t.PATTERNS.values()]


def toxic_score(t, weights, mined, text):
    votes = toxic_votes(t, mined, text)
    row = [1.0, *map(float, votes), float(any(votes)), math.log1p(sum(votes))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(row, weights, strict=True))))))
