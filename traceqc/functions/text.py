"""Column functions for report text: cleaning, fields, wrapped lines, sections, and small parsers.

A missing field is the empty string; null text gives null. ``(?U)`` makes ``\\s``, ``\\S``, ``\\d`` and ``\\b`` Unicode aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\\R|[\x1c-\x1e]"

#: Channel names and markers over text, where a conclusion ends, and sensitivities (fixed values).
OVERLAY = r"(?U)\b(?:FP|F|C|P|O|T)\d-[A-Z]+\d\b|标记"
CONCLUSION_END = r"(?U)仅供参考|起点\d+秒|处理长度"
SENSITIVITY = r"^(\d+(?:\.\d+)?)uV/(\d+(?:\.\d+)?)mm"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped, and without blanks and tabs but single ones between ASCII letters or digits."""
    return F.regexp_replace(strip(c), "(?<![A-Za-z0-9])[ \\t]+|[ \\t]+(?![A-Za-z0-9])", "")


def field(c: Column, pattern: str, group: int = 1) -> Column:
    """The cleaned group of the first match, ``""`` without one."""
    return clean(F.regexp_extract(c, f"(?U){pattern}", group))


def join_wrapped(c: Column) -> Column:
    """Cleaned lines, a line being joined to the one before where that ends in a comma, or where the line has no label
    (full-width colon) and the one before does not end a sentence."""
    lines = F.filter(F.transform(F.split(c, LINE_END), clean), lambda x: x != "")
    bound = F.transform(F.array(lines), lambda a: F.transform(a, lambda x, i: F.concat(_break(a, x, i), x)))[0]
    return F.array_join(bound, "")


def _break(lines: Column, line: Column, i: Column) -> Column:
    before = F.get(lines, i - 1)
    glued = before.rlike("[,，]$") | (~line.contains("：") & ~before.rlike("[。；;]$"))
    return F.when((i == 0) | glued, F.lit("")).otherwise(F.lit("\n"))


def bed_line(c: Column) -> Column:
    """All up to the end of the line of the bed number, ``""`` without one."""
    return F.regexp_extract(c, r"(?s)^(.*?床号[:：][^\n]*\n)", 1)


def header_and_body(c: Column, head: Column | None = None) -> tuple[Column, Column]:
    """Text split after the line of the bed number, or else at the first EEG label; one label goes from the body's start.

    ``head`` is ``bed_line(c)`` where that is a column already.
    """
    head = bed_line(c) if head is None else head
    at = F.instr(c, "脑电图：")
    header = F.when(head != "", head).otherwise(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c))
    after = F.when(at > 0, F.substring(c, at + F.lit(4), F.length(c))).otherwise("")
    body = F.when(head != "", F.substring(c, F.length(head) + 1, F.length(c))).otherwise(after)
    return header, F.regexp_replace(body, "^脑电图：", "")


def without_overlays(c: Column) -> Column:
    """Without channel names and markers drawn over the text."""
    return F.regexp_replace(c, OVERLAY, "")


def split_once(c: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first ``mark``; all and ``""`` without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substring(c, at + F.lit(len(mark)), F.length(c))).otherwise("")


def sections(body: Column) -> tuple[Column, Column, Column]:
    """EEG text, topography and conclusion; without a topography the conclusion follows the EEG text."""
    eeg, rest = split_once(body, "脑电地形图：")
    topo, conclusion = split_once(rest, "结论：")
    short, own = split_once(eeg, "结论：")
    return F.when(rest == "", short).otherwise(eeg), topo, F.when(rest == "", own).otherwise(conclusion)


def cut_conclusion(c: Column) -> Column:
    """Up to the disclaimer or the recording details."""
    return F.split(c, CONCLUSION_END, 2)[0]


def without_rules(c: Column) -> Column:
    """Lines that begin with three dashes or more become empty."""
    return F.regexp_replace(c, "(?md)^-{3,}.*$", "")


def seconds(c: Column) -> Column:
    """The first integer in a text, null without one."""
    return F.nullif(F.regexp_extract(c, r"(?U)\d+", 0), F.lit("")).try_cast("int")


def sensitivity(c: Column) -> tuple[Column, Column]:
    """Microvolts and millimetres of ``<n>uV/<m>mm`` at the start of a text, else nulls."""
    return tuple(F.nullif(F.regexp_extract(c, SENSITIVITY, g), F.lit("")).try_cast("double") for g in (1, 2))


#: Texts that pages are known to hold, names of channels, and words of filters (fixed values).
KNOWN_TEXT = (
    r"(?U)^(智能脑电|-|贵州医科大学附属医院|标记|\d+秒|\d\d:\d\d:\d\d|背景|闪光刺激|过度换气|"
    r"\d+uV/[\d.]+mm|\d厘米/秒|编号:\d+|[A-Za-z0-9]+-[A-Za-z0-9]+)$"
)
CHANNEL = "^[A-Za-z0-9]+-[A-Za-z0-9]+$"
FILTER_WORDS = "滤波|陷波|采样|Hz"


def is_known(c: Column) -> Column:
    return c.rlike(KNOWN_TEXT)
