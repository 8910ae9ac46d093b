"""Text expressions: tokens, sentences, decision markers, line packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scripts whose runs are cut into overlapping character pairs
PAIR_SCRIPTS = r"\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
# no character below these ranges belongs to one of the scripts; a cheap first look
MAYBE_PAIRS = r"[\u1100-\u11FF\u2E80-\x{10FFFF}]"
WORD = r"[\p{L}\p{Nd}]+"
TOKEN = rf"[{PAIR_SCRIPTS}]+|[\p{{L}}\p{{Nd}}&&[^{PAIR_SCRIPTS}]]+"

# fixed values: decision markers in order of precedence (name, pattern)
CORE_MARKERS = [
    ("GIRO_HADA", "기로\\s*(하|했|한|함|해)"),
    ("DOROK", "도록"),
    ("GESS", "겠"),
]
EXTENDED_MARKERS = [
    ("LGE", "(ㄹ|ᆯ|[할갈볼줄릴될둘])게(요)?([.!?\\s]|$)"),
    ("PROPOSITIVE", "(하|보|가|두|해보)자([.!?\\s]|$)"),
    ("YEJEONG", "예정"),
    ("NECESSITY", "[가-힣]야\\s*(하|한|합|해|했|할|됩|돼)"),
]



def _words(*forms: str) -> str:
    """Any of the forms as whole words, in either case of the first letter."""
    return r"(?i)(^|[^\p{L}])(" + "|".join(forms) + r")([^\p{L}]|$)"


# fixed values: decision markers of English, German, French and Spanish in order of precedence (name, pattern)
LATIN_CORE_MARKERS = [
    ("WILL", _words("will", "wird", "werden", "werde", "va", "vont", "allons", "va a", "vamos a", "van a")),
    ("SHALL", _words("shall", "soll", "sollen", "devra", "devront", "deberá", "deberán")),
    ("DECIDE", _words(
        "decided", "agreed", "resolved", "beschlossen", "entschieden", "vereinbart", "décidé", "convenu", "decidido",
        "acordado", "decidimos", "acordamos",
    )),
]
LATIN_EXTENDED_MARKERS = [
    ("PLAN", _words(
        "plan to", "plans to", "planned", "intend to", "geplant", "planen", "prévu", "prévoit", "prévoyons", "previsto",
        "planeado", "prevemos",
    )),
    ("MUST", _words(
        "must", "have to", "has to", "need to", "needs to", "muss", "müssen", "doit", "doivent", "devons", "faut", "debe",
        "deben", "debemos", "tiene que", "hay que",
    )),
]


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(col.rlike(r"\S"), F.lit(False))


#: White space that ``strip`` removes, and the space characters of Unicode (category Zs), which SQL's ``trim`` removes.
WHITE = " \t\n\x0b\f\r"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(col, F.lit(WHITE))


def tokenize(col: Column) -> Column:
    """Lower-case tokens: words of letters and digits, character pairs for CJK runs."""
    low = F.lower(F.coalesce(col, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))

    def pieces(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{PAIR_SCRIPTS}]") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    return F.when(low.rlike(MAYBE_PAIRS), F.flatten(F.transform(runs, pieces))).otherwise(words)


def sentences(col: Column, min_length: int = 11) -> Column:
    """Sentences end after ``. ! ? 。`` plus white space, or at a line break."""
    parts = F.transform(F.split(col, r"(?<=[.!?。])\s+|\n"), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_length)


def marker(col: Column, core: Sequence = CORE_MARKERS, extended: Sequence = ()) -> Column:
    """Name of the decision marker of a sentence, or null.

    Among the core markers the one that starts first wins; extended ones follow in rule order.
    """
    at = [
        F.struct(F.nullif(F.regexp_instr(col, F.lit(rx)), F.lit(0)).alias("p"), F.lit(i).alias("i"), F.lit(name).alias("m"))
        for i, (name, rx) in enumerate(core)
    ]
    # the least of no rules is null; named once, so that no rule is matched twice
    first = F.array_min(F.filter(F.array(*at), lambda s: s["p"].isNotNull()))["m"]
    rest = [F.when(col.rlike(rx), F.lit(name)) for name, rx in extended]
    return F.coalesce(first, *rest)


def is_marked(col: Column, core: Sequence = CORE_MARKERS, extended: Sequence = ()) -> Column:
    """Whether a sentence has a decision marker; it stops at the first rule that matches."""
    found = F.lit(False)
    for _, rx in [*core, *extended]:
        found = found | F.coalesce(col.rlike(rx), F.lit(False))
    return found


def pack_lines(col: Column, budget: int) -> Column:
    """Greedy packing of non-blank lines into chunks of at most ``budget`` characters.

    A line longer than the budget stands alone; line breaks are not counted. The fold keeps
    finished chunks as strings, so its cost is linear in the text.
    """
    lines = F.filter(F.split(col, "\n"), lambda s: ~is_blank(s))
    zero = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast("array<string>").alias("cur"),
        F.lit(0).alias("size"),
    )

    def step(acc: Column, line: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["size"] + F.length(line) > budget)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(acc["cur"], F.array(line))).alias("cur"),
            F.when(full, F.length(line)).otherwise(acc["size"] + F.length(line)).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(
            acc["done"]
        )

    return F.aggregate(lines, zero, step, finish)


def outer_json(col: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, or null."""
    start = F.instr(col, "{")
    back = F.instr(F.reverse(col), "}")
    end = F.length(col) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substr(col, start, end - start + 1))
