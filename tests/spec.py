"""The tagger's rules in plain Python, written for the tests from the rules alone; checked against the golden vectors."""

from __future__ import annotations

import base64
import hashlib
import re


def digest(text: str) -> str:
    return base64.urlsafe_b64encode(hashlib.sha512(text.encode()).digest()[:24]).decode()


def ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]


def exons(pos, operations):
    """Exons are what lies between introns: bases of a run of operations without N, as in the relational form."""
    runs, at = [[]], 0
    for n, o in operations:
        if o == "N":
            runs.append([])
            at += n
        else:
            runs[-1].append((at, n, o))
            at += n if o in "MD=X" else 0
        if o == "N":
            runs[-1].append((at, 0, "N"))
    ends, here = [], 0
    for n, o in operations:
        if o == "N":
            ends.append(here)
        here += n if o in "MD=X" or o == "N" else 0
    ends.append(here)
    out = []
    for k, run in enumerate(runs):
        opened = [a for a, _, o in run if o in "M=X"]
        if k == 0 and (len(runs) > 1 or ends[0] > 0):
            out.append((pos, pos + ends[0] - 1))
        elif k and opened:
            out.append((pos + opened[0], pos + ends[k] - 1))
    return out


def half_even(v, q):
    low = v // q
    twice = 2 * (v - low * q)
    return (low + (twice > q or twice == q and low % 2 == 1)) * q


def serials(chr32, strand, e, mode="middle"):
    start, end, total = e[0][0], e[-1][1], sum(b - a + 1 for a, b in e)
    plus = strand == "+"
    if mode == "middle":
        at = half_even((start + end) // 2, 10_000)
    else:
        at = start // 10_000 * 10_000 if plus == (mode == "5prime") else -(-end // 10_000) * 10_000
    between = [str(x) for (_, a), (b, _) in zip(e, e[1:]) for x in (a, b)]
    head = [chr32, strand]
    return {
        "xi": "|".join(head + [f"{a}:{b}" for a, b in e]),
        "xb": f"{chr32[:8]}{'p' if plus else 'm'}.{start:x}.{end:x}",
        "xs": f"{chr32[:8]}{'p' if plus else 'm'}." + ".".join(f"{int(x):x}" for x in between) if between else "single",
        "xt": "|".join(head + [str(at), str(half_even(total, 1000)), str(half_even(end - start, 1000))] + between),
        "xc": "|".join(head + [str((start + end) // 2 // 1000)] + [str((b - a + 1) // 10) for a, b in e]),
        "x5": "|".join(head + [str((start if plus else end) // 200)]),
        "x3": "|".join(head + [str((end if plus else start) // 200)]),
    }


def md(text):
    """offset -> (kind, base)"""
    out, at = {}, 0
    for number, gone, base in re.findall(r"([0-9]+)|\^([A-Za-z]+)|([A-Za-z])", text):
        if number:
            at += int(number)
        for c in gone:
            out[at] = ("D", c.upper())
            at += 1
        if base:
            out[at] = ("X", base.upper())
            at += 1
    return out


def variants(pos, operations, seq, text):
    if not text or seq in ("", "*", None):
        return []
    events, r, q, m, out = md(text), pos - 1, 0, 0, []
    for n, o in operations:
        if o in "M=X":
            for i in range(n):
                kind, base = events.get(m + i, ("", ""))
                alt = seq[q + i : q + i + 1].upper()
                if kind == "X" and base in "ACGT" and alt and alt in "ACGT" and base != alt:
                    out.append((r + i, base, alt))
            r, q, m = r + n, q + n, m + n
        elif o == "I":
            out.append((r, "", seq[q : q + n].upper()))
            q += n
        elif o == "D":
            out.append((r, "".join(events[m + i][1] if events.get(m + i, ("",))[0] == "D" else "N" for i in range(n)), ""))
            r, m = r + n, m + n
        elif o == "N":
            r += n
        elif o == "S":
            q += n
    return out
