"""Text column expressions: cleaning, tokens and seeded word augmentations.

Everything is a built-in Spark expression (regexp, split, transform, filter),
so cleaning runs inside whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points with the Unicode property Emoji, but for the
# digits, "#" and "*" (emoji only as keycaps) and the regional indicators
# (emoji only in pairs). Arrows, stars and ticks without it are text.
EMOJI_POINTS = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F
2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C
26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5
26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E
2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297
3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A
1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596
1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC
1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC
1FADF-1FAE9 1FAF0-1FAF8
"""


def _emoji_class() -> str:
    parts = [r.split("-") for r in EMOJI_POINTS.split()]
    return "".join("-".join(rf"\x{{{x}}}" for x in p) for p in parts)


# Flags (pairs of regional indicators), keycaps, and emoji with variation
# selectors, skin tones, tag sequences and joiners.
EMOJI_PATTERN = (
    r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|[" + _emoji_class() + r"][\x{FE0F}\x{FE0E}\x{200D}"
    r"\x{1F3FB}-\x{1F3FF}\x{E0020}-\x{E007F}]*)+"
)

# The same matches; the lookaheads only save the tests of the long class on
# characters that cannot match.
_CANDIDATES = r"\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}"
EMOJI_SCAN = EMOJI_PATTERN.replace("(?:", r"(?:(?=[#*0-9" + _CANDIDATES + "])(?:", 1).replace("|[" + _emoji_class(), "|(?=[" + _CANDIDATES + "])[" + _emoji_class(), 1)[:-2] + "))+"

# Whitespace as Python's str.split() sees it: Unicode White_Space plus the
# four information separators U+001C..U+001F.
WHITESPACE_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"
# The same runs but for those that are one plain space.
ODD_RUN = r"(?U)[\s\x{1c}-\x{1f}](?:[\s\x{1c}-\x{1f}]+|(?<! ))"

# Placeholder tokens deleted by cleaning (literal, case-sensitive).
PLACEHOLDERS = ("[NAME]", "[USER]", "[URL]")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Every character that can start or complete an emoji match above (a
# superset): texts without one skip the replacement scan entirely.
EMOJI_CANDIDATE = f"[{_CANDIDATES}]"


def strip_emoji(text) -> Column:
    """B1. A single-class ``rlike`` guard runs first; the alternation-heavy
    replacement only runs on texts that contain a candidate character."""
    t = _c(text)
    return F.when(t.rlike(EMOJI_CANDIDATE), F.regexp_replace(t, EMOJI_SCAN, "")).otherwise(t)


def collapse_whitespace(text) -> Column:
    """B2: ``" ".join(text.split())``. Single spaces, most of a text's white
    space, are left as they are and not replaced by themselves."""
    return F.trim(F.regexp_replace(_c(text), ODD_RUN, " "))


def drop_placeholders(text, placeholders=PLACEHOLDERS) -> Column:
    """Literal deletions (after the whitespace collapse, so edge and
    double spaces may remain)."""
    out = _c(text)
    for p in placeholders:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def clean_text(text, normalize_after: bool = False) -> Column:
    """B4 + B1 + B2 + B3: null -> "", emoji removed, whitespace collapsed,
    placeholders removed. ``normalize_after`` re-collapses the spaces the
    placeholder removal leaves behind (off by default)."""
    out = drop_placeholders(collapse_whitespace(strip_emoji(F.coalesce(_c(text), F.lit("")))))
    return collapse_whitespace(out) if normalize_after else out


def words(text) -> Column:
    """Whitespace-split words (Python ``str.split()``); empty text -> []."""
    t = collapse_whitespace(_c(text))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_tokens(text, min_len: int = 3) -> Column:
    """Lowercase, whitespace split, keep words of at least ``min_len``
    characters."""
    return F.filter(F.split(F.lower(_c(text)), WHITESPACE_RUN),
                    lambda w: F.length(w) >= min_len)


# ----------------------------------------------------------- seeded draws

def draw(seed: int, *parts, digits: int = 8) -> Column:
    """A uniform draw of ``4 * digits`` bits (32, at most 60) from md5(seed:part:part...). Deterministic under
    retries and repartitioning (unlike ``rand()``), and DuckDB can rebuild
    it: its leading ``digits`` hex digits read as an unsigned integer."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        piece = p.cast("string") if isinstance(p, Column) else F.lit(str(p))
        pieces += [F.lit(":"), piece]
    return F.conv(F.substring(F.md5(F.concat(*pieces)), 1, digits), 16, 10).cast("long")


def swap_delete_positions(words_col, d1, d2, d3) -> dict[str, Column]:
    """Positions for B23 from three non-negative draws: two distinct swap
    positions ``_pa``/``_pb`` and a delete position ``_pd`` (0-based)."""
    n = F.size(_c(words_col))
    ok = n > 3  # positions are only used for texts of more than 3 words
    a = F.pmod(_c(d1), n)
    return {"_pa": F.when(ok, a),
            "_pb": F.when(ok, F.pmod(a + 1 + F.pmod(_c(d2), n - 1), n)),
            "_pd": F.when(ok, F.pmod(_c(d3), n))}


def swap_delete(words_col, kind, pa, pb, pd) -> Column:
    """Kind 0 = swap two distinct words, 1 = delete one word, 2 = swap
    then delete; applied only when there are more than 3 words. Positions
    come from ``swap_delete_positions`` (materialised as columns)."""
    w, a, b, dl = _c(words_col), _c(pa), _c(pb), _c(pd)
    n = F.size(w)
    swapped = F.transform(
        w, lambda x, i: F.when(i == a, F.element_at(w, (b + 1).cast("int")))
        .when(i == b, F.element_at(w, (a + 1).cast("int"))).otherwise(x))
    k = _c(kind)
    after_swap = F.when(k.isin(0, 2), swapped).otherwise(w)
    deleted = F.filter(after_swap, lambda x, i: i != dl)
    out = F.when(k.isin(1, 2), deleted).otherwise(after_swap)
    return F.when(n > 3, out).otherwise(w)


def dropout_and_swap(words_col, fire_drop, fire_swap, drop_idx, s1, s2) -> Column:
    """B21 + B22: word dropout removes the positions in ``drop_idx``
    (``n//10`` draws, possibly repeated); word swap exchanges positions s1 and
    s2 (may coincide). Both are computed from the original words and the swap
    wins when both fire; nothing happens for 4 words or fewer. All inputs are
    materialised columns."""
    w, s1, s2, di = _c(words_col), _c(s1), _c(s2), _c(drop_idx)
    n = F.size(w)
    # kept positions via a hash-based set difference: O(n), not O(n * |drop|)
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), di)
    dropped = F.transform(kept, lambda j: F.element_at(w, (j + 1).cast("int")))
    swapped = F.transform(
        w, lambda x, i: F.when(i == s1, F.element_at(w, (s2 + 1).cast("int")))
        .when(i == s2, F.element_at(w, (s1 + 1).cast("int"))).otherwise(x))
    out = F.when(_c(fire_swap), swapped).when(_c(fire_drop), dropped).otherwise(w)
    return F.when(n > 4, out).otherwise(w)
