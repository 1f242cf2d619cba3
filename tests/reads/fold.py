"""Plain versions of alignment functions, one base at a time."""

from __future__ import annotations

import re


def ops_of(cigar):
    return [(o, int(n or 0)) for n, o in re.findall(r"(\d*)([MIDNSHP=X])", cigar)]


def walk(cigar, seq, ref):
    """(kind, reference base, read base) of each consumed base."""
    r = s = 0
    for op, n in ops_of(cigar):
        for _ in range(n):
            base = ref[r] if r < len(ref) else "N"
            if op in "M=X":
                yield op, base, seq[s]
                r, s = r + 1, s + 1
            elif op in "DN":
                yield op, base, ""
                r += 1
            elif op in "IS":
                yield op, "", seq[s]
                s += 1


def md(cigar, seq, ref):
    out, run, deleting = "", 0, False
    at = list(walk(cigar, seq, ref))
    marks = {}
    i = 0
    for op, n in ops_of(cigar):
        if op == "D":
            marks[i] = True
        i += n if op in "M=XDNIS" else 0
    for i, (op, r, s) in enumerate(at):
        if op == "D":
            if i in marks or not deleting:
                out, run = f"{out}{run}^", 0
            out += r
            deleting = True
            continue
        deleting = deleting and op in "NIS"
        if op in "M=X":
            deleting = False
            if r == s:
                run += 1
            else:
                out, run = f"{out}{run}{r}", 0
    return f"{out}{run}"


def nm(cigar, seq, ref):
    return sum((op in "M=X" and r != s) or op in "DI" for op, r, s in walk(cigar, seq, ref))


def xd(md_text):
    """By tokens: a run of 0 goes, a deletion gets its end mark."""
    tokens = re.findall(r"(\d+)|(\^\D*)|(\D)", md_text)
    return "".join(("" if run == "0" else run) or (gone and f"{gone}$") or base for run, gone, base in tokens)


def split(cigar, seq, ref):
    out = []
    r = s = 0
    for op, n in ops_of(cigar):
        if op in "M=X" and n:
            for i in range(n):
                kind = "=" if r + i < len(ref) and ref[r + i] == seq[s + i] else "X"
                if out and out[-1][0] == kind and out[-1][1]:
                    out[-1][1] += 1
                else:
                    out.append([kind, 1])
        else:
            out.append([op, n])
        r += n if op in "M=XDN" else 0
        s += n if op in "M=XIS" else 0
    return "".join(f"{n}{o}" for o, n in out)


def pairs(rows):
    """Mates of one name's reads (row, chr, pos, span, pchr, ploc, tlen) in order."""
    out, first = {}, None
    for b in rows:
        a = first
        if a is None:
            first = b
            continue
        off = b["pos"] + a["span"] - a["pos"] - a["tlen"]
        if (
            b["tlen"] == -a["tlen"] and b["pos"] == a["ploc"] and b["ploc"] == a["pos"]
            and a["pchr"] in ("=", a["chr"]) and a["tlen"] >= 0 and off in (0, 1)
        ):
            out[b["row"]] = ("look_back", a["row"], off)
            out[a["row"]] = ("look_ahead", b["row"], off)
        else:
            first = b
    return out
