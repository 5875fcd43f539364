"""Digests and GA4GH identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An accession, with or without the name space in front.
ACCESSION = r"^(ga4gh:)?SQ\.[0-9A-Za-z_-]{32}$"


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper(seq: Column) -> Column:
    """a to z in upper case; sequences are ASCII, and any other character stays the one that it is."""
    return F.translate(seq, _LOWER, _UPPER)


def sha512t24u(value: Column) -> Column:
    """base64url of the first 24 bytes of SHA-512: 32 characters."""
    text = F.base64(F.unhex(F.substring(F.sha2(value.cast("binary"), 512), 1, 48)))
    # Not translate, which looks up every character.
    return F.replace(F.replace(text, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def mask_ambiguous(seq: Column, keep: bool = False) -> Column:
    """Upper case, and N for all but A, C, G, T and N unless ``keep``."""
    return upper(seq) if keep else F.regexp_replace(upper(seq), "[^ACGTN]", "N")


def ambiguous_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(upper(seq), "[ACGTN]", "")).cast("long")


def normalize_sequence(seq: Column, keep: bool = False) -> Column:
    """Upper case without white space; an error for anything but IUPAC codes; masked unless ``keep``."""
    bare = F.regexp_replace(upper(seq), r"\s", "")
    wrong = F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), F.substring(F.regexp_replace(bare, "[ACGTURYKMSWBDHVN]", ""), 1, 20)))
    return F.when(bare.rlike("[^ACGTURYKMSWBDHVN]"), wrong.cast("string")).otherwise(mask_ambiguous(bare, keep))


def refget_id(seq: Column, keep: bool = False) -> Column:
    return F.concat(F.lit("SQ."), sha512t24u(normalize_sequence(seq, keep)))


def bare_accession(accession: Column) -> Column:
    """The accession without its name space; an error if it isn't one."""
    wrong = F.raise_error(F.concat(F.lit("not a refget accession: "), F.coalesce(accession, F.lit("null")))).cast("string")
    return F.when(accession.rlike(ACCESSION), F.regexp_replace(accession, "^ga4gh:", "")).otherwise(wrong)


def location_digest(accession: Column, start: Column, ref: Column) -> Column:
    """Digest of the location that ``ref`` takes from ``start`` (counted from 0 between residues)."""
    text = F.concat(
        F.lit('{"end":'), (start + F.length(ref)).cast("string"), F.lit(',"sequenceReference":{"refgetAccession":"'), accession,
        F.lit('","type":"SequenceReference"},"start":'), start.cast("string"), F.lit(',"type":"SequenceLocation"}'),
    )
    return sha512t24u(text)


def allele_id(accession: Column, start: Column, ref: Column, alt: Column) -> Column:
    """VRS v2 identifier of a substitution that is already normalised."""
    text = F.concat(
        F.lit('{"location":"'), location_digest(accession, start, ref), F.lit('","state":{"sequence":"'), alt,
        F.lit('","type":"LiteralSequenceExpression"},"type":"Allele"}'),
    )
    return F.concat(F.lit("ga4gh:VA."), sha512t24u(text))


def normalize_substitution(start: Column, ref: Column, alt: Column) -> Column:
    """struct(start, ref, alt) without common suffix, then prefix; an error if a side becomes empty."""
    ref, alt = F.upper(ref), F.upper(alt)
    least = F.least(F.length(ref), F.length(alt))

    def common(a: Column, b: Column) -> Column:
        """Length of the common prefix."""
        size = F.least(F.length(a), F.length(b))
        step = lambda n, i: F.when((n == i - 1) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(n)
        return F.when(size == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), step))

    tail = common(F.reverse(ref), F.reverse(alt))
    cut = lambda s, n: s.substr(F.lit(1), F.length(s) - n)
    r, a = cut(ref, tail), cut(alt, tail)
    head = common(r, a)
    rest = lambda s: s.substr(head + 1, F.length(s))
    empty = (F.length(rest(r)) == 0) | (F.length(rest(a)) == 0) | (least == 0)
    wrong = F.raise_error(F.lit("only substitutions have an identifier")).cast("struct<start:bigint,ref:string,alt:string>")
    return F.when(empty, wrong).otherwise(F.struct((start.cast("long") + head).alias("start"), rest(r).alias("ref"), rest(a).alias("alt")))
