"""MD tags and the walk over CIGAR and MD as column expressions; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.folds import BLOCK, appended, either, emitting, let

EVENTS = "array<struct<off:bigint,kind:string,base:string>>"
VARIANTS = "array<struct<start:bigint,ref:string,alt:string>>"


def md_events(md: Column) -> Column:
    """array<struct<off, kind, base>>: X for a mismatch, D for a deleted base; offsets count aligned and deleted bases."""
    found = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))

    def step(a: Column, t: Column) -> Column:
        event = lambda off, kind, base: F.struct(off.alias("off"), F.lit(kind).alias("kind"), base.alias("base"))
        state = lambda move, out: F.struct((a["off"] + move).alias("off"), out.alias("out"))
        bases = F.filter(F.split(F.upper(F.substring(t, 2, 1 << 30)), ""), lambda c: c != "")
        deleted = let(bases, lambda cs: state(F.size(cs).cast("long"), F.concat(a["out"], F.transform(cs, lambda c, i: event(a["off"] + i, "D", c)))))
        # A token begins with a digit, a letter or ^, and digits come before ":", the others after it.
        return either(t < ":", state(t.try_cast("long"), a["out"]), either(t.startswith("^"), deleted, state(F.lit(1).cast("long"), appended(a["out"], event(a["off"], "X", F.upper(t))))))

    return emitting(F.coalesce(found, F.array().cast("array<string>")), {"off": F.lit(0).cast("long")}, EVENTS, step, lambda a: a["out"])


def segments(ops: Column, pos: Column) -> Column:
    """Operations with where they start: r in the reference (from 0), q in the read, m in the MD."""
    kind = "array<struct<n:bigint,o:string,r:bigint,q:bigint,m:bigint>>"
    zero = F.lit(0).cast("long")
    begin = {"r": pos.cast("long") - 1, "q": zero, "m": zero}

    def step(a: Column, x: Column) -> Column:
        move = lambda k, names: F.when(x["o"].isin(*names), a[k] + x["n"]).otherwise(a[k]).alias(k)
        return F.struct(move("r", "M=XDN"), move("q", "M=XIS"), move("m", "M=XD"), appended(a["out"], F.struct(x["n"].alias("n"), x["o"].alias("o"), a["r"].alias("r"), a["q"].alias("q"), a["m"].alias("m"))).alias("out"))

    return F.when(ops.isNotNull(), emitting(ops, begin, kind, step, lambda a: a["out"]))


def _is_base(c: Column) -> Column:
    return c.isin("A", "C", "G", "T")


def _variant(start: Column, ref: Column, alt: Column) -> Column:
    return F.struct(start.alias("start"), ref.alias("ref"), alt.alias("alt"))


def candidates(ops: Column, pos: Column, seq: Column, md: Column) -> Column:
    """Substitutions, insertions and deletions of a read, in its order. None without MD or SEQ.

    A read base past the end of SEQ is no variant; ``seq_too_short`` counts such reads. Where operations and MD events
    both fit a block of a fold, each operation looks for its own events; see ``_sorted_candidates`` for the others."""
    there = (F.coalesce(md, F.lit("")) != "") & ~F.coalesce(seq, F.lit("")).isin("", "*")
    few = lambda events: (F.size(ops) <= BLOCK) & (F.size(events) <= BLOCK)
    found = let(md_events(md), lambda events: F.when(few(events), _few_candidates(ops, pos, seq, events)).otherwise(_sorted_candidates(ops, pos, seq, events)))
    return F.when(there, found).otherwise(F.array().cast(VARIANTS))


def _few_candidates(ops: Column, pos: Column, seq: Column, events: Column) -> Column:
    """One fold over the operations, every one of which looks through all events."""
    zero, none = F.lit(0).cast("long"), F.lit("")

    def step(a: Column, x: Column) -> Column:
        o, n = x["o"], x["n"]
        state = lambda r, q, m, out: F.struct(*[(a[k] + n if moves else a[k]).alias(k) for k, moves in (("r", r), ("q", q), ("m", m))], out.alias("out"))
        inside = lambda e, kind: (e["off"] >= a["m"]) & (e["off"] < a["m"] + n) & (e["kind"] == kind)
        read = lambda e: F.upper(seq.substr((a["q"] + e["off"] - a["m"] + 1).cast("int"), F.lit(1)))
        changes = F.transform(F.filter(events, lambda e: inside(e, "X")), lambda e: _variant(a["r"] + e["off"] - a["m"], e["base"], read(e)))
        changes = F.filter(changes, lambda v: _is_base(v["ref"]) & _is_base(v["alt"]) & (v["ref"] != v["alt"]))
        match = state(True, True, True, either(F.exists(events, lambda e: inside(e, "X")), F.concat(a["out"], changes), a["out"]))
        # A base of a deletion that the MD doesn't name is N.
        text = F.aggregate(F.filter(events, lambda e: inside(e, "D")), none, lambda s, e: F.concat(F.rpad(s, (e["off"] - a["m"]).cast("int"), "N"), e["base"]))
        gone = state(True, False, True, appended(a["out"], _variant(a["r"], F.rpad(text, n.cast("int"), "N"), none)))
        added = state(False, True, False, appended(a["out"], _variant(a["r"], none, F.upper(seq.substr((a["q"] + 1).cast("int"), n.cast("int"))))))
        skip, clip = state(True, False, False, a["out"]), state(False, True, False, a["out"])
        return either(o == "M", match, either(o == "N", skip, either(o.isin("=", "X"), match, either(o == "I", added, either(o == "D", gone, either(o == "S", clip, a))))))

    begin = F.struct((pos.cast("long") - 1).alias("r"), zero.alias("q"), zero.alias("m"), F.array().cast(VARIANTS).alias("out"))
    return F.aggregate(ops, begin, step, lambda a: a["out"])


def _sorted_candidates(ops: Column, pos: Column, seq: Column, events: Column) -> Column:
    """Operations and MD events are sorted together by where they stand in the MD and folded once, so a read's cost grows
    with its operations and events, not with their product."""
    zero, none = F.lit(0).cast("long"), F.lit("")
    item = lambda at, kind, k, o, n, r, q, base: F.struct(at.alias("at"), F.lit(kind).alias("kind"), k.alias("k"), o.alias("o"), n.alias("n"), r.alias("r"), q.alias("q"), base.alias("base"))
    steps = F.transform(F.filter(segments(ops, pos), lambda g: g["o"].isin("M", "=", "X", "I", "D")), lambda g, k: item(g["m"], 0, k, g["o"], g["n"], g["r"], g["q"], none))
    items = F.transform(events, lambda e: item(e["off"], 1, F.lit(0), e["kind"], zero, zero, zero, e["base"]))

    def closed(a: Column) -> Column:
        """A deletion is complete when the next operation comes; a base of it that the MD doesn't name is N."""
        return F.when(a["o"] == "D", appended(a["out"], _variant(a["r"], F.rpad(a["text"], a["n"].cast("int"), "N"), none))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        inside = x["at"] < a["m"] + a["n"]
        alt = F.upper(seq.substr((a["q"] + x["at"] - a["m"] + 1).cast("int"), F.lit(1)))
        change = a["o"].isin("M", "=", "X") & (x["o"] == "X") & inside & _is_base(x["base"]) & _is_base(alt) & (x["base"] != alt)
        added = _variant(x["r"], none, F.upper(seq.substr((x["q"] + 1).cast("int"), x["n"].cast("int"))))
        began = F.struct(F.when(x["o"] == "I", none).otherwise(x["o"]).alias("o"), x["at"].alias("m"), x["n"].alias("n"), x["r"].alias("r"), x["q"].alias("q"), none.alias("text"), F.when(x["o"] == "I", appended(closed(a), added)).otherwise(closed(a)).alias("out"))
        text = F.when((a["o"] == "D") & (x["o"] == "D") & inside, F.concat(F.rpad(a["text"], (x["at"] - a["m"]).cast("int"), "N"), x["base"])).otherwise(a["text"])
        met = F.struct(a["o"].alias("o"), a["m"].alias("m"), a["n"].alias("n"), a["r"].alias("r"), a["q"].alias("q"), text.alias("text"), F.when(change, appended(a["out"], _variant(a["r"] + x["at"] - a["m"], x["base"], alt))).otherwise(a["out"]).alias("out"))
        return F.when(x["kind"] == 0, began).otherwise(met)

    begin = {"o": none, "m": zero, "n": zero, "r": zero, "q": zero, "text": none}
    return emitting(F.sort_array(F.concat(steps, items)), begin, VARIANTS, step, closed)


def seq_too_short(ops: Column, seq: Column) -> Column:
    used = F.aggregate(F.filter(ops, lambda x: x["o"].isin("M", "I", "S", "=", "X")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return ~F.coalesce(seq, F.lit("")).isin("", "*") & (F.length(seq) < used)
