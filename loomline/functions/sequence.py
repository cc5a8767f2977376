"""Column functions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters a sequence may hold, and the 26 letters dealt to four bases in turn.
ALPHABET = "ACGTURYKMSWBDHWNXV"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "".join("ACGT"[i % 4] for i in range(26))


def complement(seq: Column) -> Column:
    """Complement of A, C, G, T; any other character becomes N."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def plain_reverse_complement(seq: Column) -> Column:
    """The same for strings that are known to hold only A, C, G and T, without the pattern."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_canonical(kmer: Column) -> Column:
    return kmer < reverse_complement(kmer)


def pack(kmer: Column) -> Column:
    """A k-mer of A, C, G, T (k up to 31) as a number with two bits a base."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(packed: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def base_code(ch: Column) -> Column:
    """0 to 3 for A, C, G, T, else -1."""
    return F.coalesce(*(F.when(ch == b, i) for i, b in enumerate("ACGT")), F.lit(-1))


def decode_base(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, "ACGT")), code), F.lit("N"))


def is_valid(seq: Column) -> Column:
    return seq.rlike(f"^[{ALPHABET}]*$")


def is_definite(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def checked(seq: Column) -> Column:
    """seq in upper case without white space; fails on a character outside the alphabet."""
    clean = F.upper(F.regexp_replace(seq, r"\s", ""))
    return F.when(is_valid(clean), clean).otherwise(F.raise_error(F.concat(F.lit("invalid character in sequence: "), F.substring(clean, 1, 40))))


def first_token(header: Column) -> Column:
    token = F.get(F.split(F.trim(header), r"\s+"), 0)
    return F.when(F.coalesce(token, F.lit("")) != "", token).otherwise(F.raise_error(F.lit("a record has no name")))


def wrapped(seq: Column, width: int = 80) -> Column:
    """seq in lines of width characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def letters_to_bases(text: Column) -> Column:
    """Any text as a sequence: its ASCII letters, dealt to the four bases."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), LETTERS, BASES)


def signed_step(token: Column) -> Column:
    """A path token such as 12+ or 7- as a signed number."""
    return F.concat(F.right(token, F.lit(1)), F.regexp_replace(token, r".$", "")).cast("long")
