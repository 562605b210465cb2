"""Plain-Python statements of the text rules, written for the tests."""

import re

# fixed values: spellings that the rules replace, in this order
FIXES = [("rythmn", "rhythm"), ("whch", "which"), ("gonna", "going to")]


def normalise(text):
    t = text.lower()
    for a, b in FIXES:
        t = t.replace(a, b)
    t = t.replace("-", " ")
    t = "".join(ch for ch in t if ch.isalnum() or ch == "_" or ch.isspace() or ch == "'")
    for first, glued in (("p", "pm"), ("a", "am")):
        t = re.sub(rf"\b{first}\s*m\b", glued, t)
    return t.split()


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def parse(text):
    tags = re.findall(r"\[(Question|Answer|Follow-up)\]:", text)
    parts = re.split(r"\[(?:Question|Answer|Follow-up)\]:", text)[1:]
    return [(t, p.strip()) for t, p in zip(tags, parts)]


def merge(blocks):
    out = []
    for tag, text in blocks:
        tag = "Question" if tag == "Follow-up" else tag
        if not text:
            continue
        if out and out[-1][0] == tag:
            out[-1] = (tag, out[-1][1] + " " + text)
        else:
            out.append((tag, text))
    return out


def render(runs):
    return "\n".join(f"[{t}]: {x}" for t, x in runs)
