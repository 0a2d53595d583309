"""Daitch-Mokotoff sound codes of names."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SLAVIC_DROPPED, SLAVIC_MULTI, SLAVIC_SINGLE
from .vectors import bind

CODE_LENGTH = 6
VOWELS = "AEIJOUY"

# The published rule table, spelling -> code at the start, before a
# vowel, elsewhere. "-" is not coded, "a|b" are two readings.
DM_RULES = """
AI AJ AY=0 1 -
AU=0 7 -
A=0 - -
B=7 7 7
CHS=5 54 54
CH=5|4 5|4 5|4
CK=5|45 5|45 5|45
C=5|4 5|4 5|4
CZ CS CSZ CZS=4 4 4
DRZ DRS=4 4 4
DS DSH DSZ=4 4 4
DZ DZH DZS=4 4 4
D DT=3 3 3
EI EJ EY=0 1 -
EU=1 1 -
E=0 - -
FB=7 7 7
F=7 7 7
G=5 5 5
H=5 5 -
IA IE IO IU=1 - -
I=0 - -
J=1|4 -|4 -|4
KS=5 54 54
KH=5 5 5
K=5 5 5
L=8 8 8
MN=6-6 6-6 6-6
M=6 6 6
NM=6-6 6-6 6-6
N=6 6 6
OI OJ OY=0 1 -
O=0 - -
P PF PH=7 7 7
Q=5 5 5
RZ RS=94|4 94|4 94|4
R=9 9 9
SCHTSCH SCHTSH SCHTCH=2 4 4
SCH=4 4 4
SHTCH SHCH SHTSH=2 4 4
SHT SCHT SCHD=2 43 43
SH=4 4 4
STCH STSCH SC=2 4 4
STRZ STRS STSH=2 4 4
ST=2 43 43
SZCZ SZCS=2 4 4
SZT SHD SZD SD=2 43 43
SZ=4 4 4
S=4 4 4
TCH TTCH TTSCH=4 4 4
TH=3 3 3
TRZ TRS=4 4 4
TSCH TSH=4 4 4
TS TTS TTSZ TC=4 4 4
TZ TTZ TZS TSZ=4 4 4
T=3 3 3
UI UJ UY=0 1 -
U UE=0 - -
V=7 7 7
W=7 7 7
X=5 54 54
Y=1 - -
ZDZ ZDZH ZHDZH=2 4 4
ZD ZHD=2 43 43
ZH ZS ZSCH ZSH=4 4 4
Z=4 4 4
"""


def _rules() -> dict[str, list[list[str]]]:
    table = {}
    for line in DM_RULES.split("\n"):
        spellings, _, codes = line.partition("=")
        for spelling in spellings.split():
            table[spelling] = [place.split("|") for place in codes.split()]
    return table


def _longest_first(spellings: list[str]) -> str:
    """A pattern of the longest spelling at a place, told apart by the first letter."""
    tails = {}
    for spelling in sorted(spellings, key=len, reverse=True):
        tails.setdefault(spelling[0], []).append(spelling[1:])
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in sorted(tails.items()))


RULES = _rules()
LONGEST_FIRST = _longest_first(list(RULES))
_FOLD = str.maketrans(
    {a: b for src, dst in SLAVIC_SINGLE for a, b in zip(src, dst)}
    | {c: "" for c in SLAVIC_DROPPED}
    | SLAVIC_MULTI
)


@lru_cache(maxsize=1)
def letter_forms() -> dict[str, str]:
    """A-Z form of each character beyond ASCII that has one: Slavic letters by their
    table, all others by capital form and compatibility decomposition."""
    forms = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        capital = unicodedata.normalize("NFKD", c.translate(_FOLD).upper())
        letters = "".join(x for x in capital if "A" <= x <= "Z")
        if letters:
            forms[c] = letters
    return forms


@lru_cache(maxsize=1)
def _blank() -> str:
    """A name of nothing but white space and signs that the Slavic table drops."""
    spaces = "".join(f"\\x{{{n:x}}}" for n in range(sys.maxunicode + 1) if chr(n).isspace())
    return f"^[{spaces}{SLAVIC_DROPPED}]*$"


def _letters(name: Column) -> Column:
    """Letters A-Z of a name; only names beyond ASCII are taken apart."""
    forms = F.str_to_map(F.lit("\n".join(f"{c}={a}" for c, a in letter_forms().items())), F.lit("\n"), F.lit("="))
    plain = lambda c: F.when(c.rlike("^[A-Za-z]"), c).otherwise("")
    spelled = F.transform(F.regexp_extract_all(name, F.lit("(?s)."), 0), lambda c: F.coalesce(forms[c], plain(c)))
    ascii_form = F.when(name.rlike(r"[^\x00-\x7F]"), F.array_join(spelled, "")).otherwise(name)
    return F.regexp_replace(F.upper(ascii_form), "[^A-Z]", "")


def _joined(code: Column, addition: Column) -> Column:
    """An open code with the digits of one more sound.

    ``-`` stands for a sound without a digit. It stays only where it matters, between
    two equal digits and at the end, so that readings that will go on alike are equal
    texts. Equal neighbours count once; six digits close a code.
    """
    longer = F.regexp_replace(F.concat(code, addition), r"(.)\1+", "$1")
    needed = F.regexp_replace(longer, r"^-|(?<=(\d))-(?=\d)(?!\1)", "")
    pruned = F.when(F.contains(code, F.lit("-")) | F.contains(addition, F.lit("-")), needed).otherwise(longer)
    six_digits = F.regexp_replace(pruned, rf"^(\d(?:-?\d){{{CODE_LENGTH - 1}}}).*$", "$1")
    return F.when(F.length(code) + F.length(addition) > CODE_LENGTH, six_digits).otherwise(pruned)


def phonetic_codes(name: Column | str) -> Column:
    """Sorted codes of a name; an empty array for null and blank names.

    The rule table is a machine over the sounds of the name, whose state is the set of
    open codes. A name without a letter A-Z has the code of zeros.
    """
    name = F.col(name) if isinstance(name, str) else name
    lettered = [{s: places for s, places in RULES.items() if s[0] == letter} for letter in ascii_uppercase]
    rules = F.from_json(F.lit(json.dumps(lettered)), "array<map<string,array<array<string>>>>")

    def additions(sounds: Column) -> Column:
        def at(sound: Column, i: Column) -> Column:
            before_vowel = F.coalesce(F.get(sounds, i + 1), F.lit("")).rlike(f"^[{VOWELS}]")
            own = F.get(rules, F.ascii(sound) - ord("A"))
            return F.get(own[sound], F.when(i == 0, 0).when(before_vowel, 1).otherwise(2))

        return F.transform(sounds, at)

    def step(codes: Column, choices: Column) -> Column:
        grown = F.transform(codes, lambda code: F.transform(choices, lambda a: _joined(code, a)))
        return F.array_distinct(F.flatten(grown))

    def closed(codes: Column) -> Column:
        digits = F.transform(codes, lambda code: F.rpad(F.replace(code, F.lit("-"), F.lit("")), CODE_LENGTH, "0"))
        return F.array_sort(F.array_distinct(digits))

    sounds = F.regexp_extract_all(_letters(name), F.lit(f"({LONGEST_FIRST})"), 1)
    start = F.array(F.lit(""))
    codes = bind(sounds, lambda s: F.aggregate(additions(s), start, step, closed))
    return F.when(name.isNull() | name.rlike(_blank()), F.array().cast("array<string>")).otherwise(codes)


def phonetic_dim(df: DataFrame, *name_columns: str) -> DataFrame:
    """(name, codes) for the distinct names of some columns."""
    names = df.select(F.explode(F.array(*[F.col(c) for c in name_columns])).alias("name"))
    named = names.where((F.col("name") != "") & F.col("name").isNotNull()).distinct()
    return named.select("name", phonetic_codes("name").alias("codes"))
