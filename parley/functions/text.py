"""Scalar functions over strings, times and dates, as column expressions that stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as w

SPACE = " \t\n\r\f\u000b"
#: ASCII tokens: runs of letters, digits and inner signs; a sign at a run's end is a token of its own.
ASCII_TOKEN = r"[A-Za-z0-9._+#%/@-]*[A-Za-z0-9%]|[._+#/@-]"


def any_of(options) -> str:
    """A pattern that finds any of these strings."""
    return "|".join("".join("\\" + c if c in ".^$*+?()[]{}|\\-" else c for c in x) for x in options)


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE))


def lower_ascii(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def upper_ascii(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def equals_ignore_case(a: Column, b: Column) -> Column:
    return lower_ascii(a) == lower_ascii(b)


def split_any(s: Column, separators: str) -> Column:
    """Parts between any of these characters; empty parts are dropped."""
    return F.filter(F.split(s, "[" + "".join("\\" + c for c in separators) + "]"), lambda x: x != "")


def split_lines(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "\n"), trim), lambda x: x != "")


def pad_left(s: Column, width: int, fill: str) -> Column:
    """At least `width` characters; longer strings stay whole."""
    return F.concat(F.repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.octet_length(s))), s)


def half_width(s: Column) -> Column:
    return F.translate(s, w.FULL_WIDTH, w.HALF_WIDTH)


def convert_characters(s: Column, pairs: dict[str, str]) -> Column:
    """Each character of `pairs` replaced by its partner, as in traditional to simplified script."""
    return F.translate(s, "".join(pairs), "".join(pairs.values())) if pairs else s


def has_cjk(s: Column) -> Column:
    return s.rlike(f"[{w.CJK}]")


def cjk_chars(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{w.CJK}]"))


def is_content(s: Column) -> Column:
    """Words that carry content: a CJK or ASCII letter or digit, no CJK punctuation, not only digits and dots."""
    return s.rlike(f"[{w.CJK}A-Za-z0-9]") & ~s.rlike(f"[{w.CJK_PUNCTUATION}]") & ~s.rlike("^[0-9.]+$")


def ascii_tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(ASCII_TOKEN), F.lit(0))


def sentences(s: Column) -> Column:
    """Pieces up to and with a sentence's end marks and what closes them; a line break cuts too."""
    end = "".join("\\" + c if c in ".?" else c for c in w.SENTENCE_END)
    pattern = f"[^{end}\n]*[{end}][{w.CLOSERS}]*|[^{end}\n]+"
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), trim), lambda x: x != "")


def needs_conversion(s: Column, characters: dict[str, str]) -> Column:
    """Whether a text holds any character of the map."""
    return F.translate(s, "".join(characters), "") != s if characters else s.isNull() & F.lit(False)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def markdown_cell(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def safe_name(s: Column, fallback: str = "untitled") -> Column:
    """A file name: signs that systems forbid become _, dots at the ends go, device names get a prefix."""
    out = trim(F.regexp_replace(s, r'[/\\:*?"<>|\x00-\x1f]', "_"))
    out = F.regexp_replace(trim(F.regexp_replace(out, r"\.+$", "")), r"^\.+", "")
    device = upper_ascii(F.substring_index(out, ".", 1)).isin(*w.RESERVED_NAMES)
    return F.when(out == "", F.lit(fallback)).when(device, F.concat(F.lit(fallback + "_"), out)).otherwise(out)


def number_string(x: Column, decimals: int) -> Column:
    """Fixed notation without zeros at the end; what is not finite, and -0, is 0."""
    out = F.format_string(f"%.{decimals}f", x.cast("double"))
    out = F.when(out.contains("."), F.regexp_replace(F.regexp_replace(out, "0+$", ""), r"\.$", "")).otherwise(out)
    fine = ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.when(fine & (out != "-0"), out).otherwise("0")


def _part(ms: Column, unit: int, modulo: int | None = None) -> Column:
    whole = F.floor(F.greatest(ms, F.lit(0)) / unit)
    return (whole % modulo if modulo else whole).cast("long")


def duration(ms: Column) -> Column:
    """HH:MM:SS, hours without bound."""
    return F.format_string("%02d:%02d:%02d", _part(ms, 3600000), _part(ms, 60000, 60), _part(ms, 1000, 60))


def srt_time(ms: Column) -> Column:
    return F.concat(duration(ms), F.lit(","), F.lpad(_part(ms, 1, 1000).cast("string"), 3, "0"))


def clock(ms: Column) -> Column:
    return F.concat(duration(ms), F.lit("."), F.lpad(_part(ms, 1, 1000).cast("string"), 3, "0"))


def spoken_duration(ms: Column) -> Column:
    """Hours, minutes and, under an hour, seconds in words; zero parts are left out."""
    hours, minutes, seconds = _part(ms, 3600000), _part(ms, 60000, 60), _part(ms, 1000, 60)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(" " + unit))
    out = F.concat_ws(" ", F.when(hours > 0, said(hours, "小时")), F.when(minutes > 0, said(minutes, "分钟")), F.when((hours == 0) & (seconds > 0), said(seconds, "秒")))
    return F.when(ms.isNotNull(), F.when(out == "", "0 秒").otherwise(out))


def real_time_factor(audio_ms: Column, elapsed_ms: Column) -> Column:
    """Time heard for each time worked; 0 where either is not known."""
    return F.when((audio_ms > 0) & (elapsed_ms > 0), audio_ms / elapsed_ms).otherwise(0.0)


def short_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d", _part(ms, 60000), _part(ms, 1000, 60))


def samples_to_ms(samples: Column, rate: Column) -> Column:
    return F.floor(samples * 1000 / rate).cast("long")


def ms_to_samples(ms: Column, rate: Column) -> Column:
    return F.floor((ms * rate + 500) / 1000).cast("long")


def parse_date(s: Column) -> Column:
    """A date of year 1900-2200, month 1-12, day 1-31, parts set apart by -, / or .; null for days that don't exist."""
    part = lambda i: F.regexp_extract(s, r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", i)
    year = F.try_to_number(part(1), F.lit("9999"))
    text = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when((year >= 1900) & (year <= 2200), F.try_to_date(text, "yyyy-MM-dd"))


def weekday(d: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(d) + 1


def weekday_name(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit("星期" + c) for c in "一二三四五六日"]), weekday(d))


def is_question(s: Column) -> Column:
    return trim(s).rlike("[？?]$")


def decision_kind(s: Column) -> Column:
    """The kind of decision that a sentence states, or null."""
    text = trim(s)
    kind = F.lit(None).cast("string")
    for name, triggers in reversed(w.DECISIONS):
        if name == "同意":
            kind = F.when(text.rlike(any_of(triggers)), F.when(text.rlike(any_of(w.DENIALS)), "否决").otherwise(name)).otherwise(kind)
        else:
            kind = F.when(text.rlike(any_of(triggers)), name).otherwise(kind)
    return kind


def is_decision(s: Column) -> Column:
    return ~is_question(s) & ~s.rlike(any_of(w.ENQUIRIES)) & decision_kind(s).isNotNull()


def action_trigger(s: Column) -> Column:
    """The first trigger, in the order of the list, that a sentence holds; null for a question."""
    found = F.coalesce(*[F.when(s.contains(t), F.lit(t)) for t in w.ACTION_TRIGGERS])
    return F.when(~is_question(s), found)


def priority(s: Column) -> Column:
    return F.when(s.rlike(any_of(w.HIGH)), "高").when(s.rlike(any_of(w.LOW)), "低").otherwise("中")


def interrogative(s: Column) -> Column:
    return trim(s).rlike(f"({any_of(w.QUESTION_ENDS)})$") | s.rlike(any_of(w.QUESTION_INNER))


def imperative(s: Column) -> Column:
    return trim(s).rlike(f"^({any_of(w.IMPERATIVE_STARTS)})")


def blank_speech(s: Column) -> Column:
    """True for what a recogniser writes for silence, such as [BLANK_AUDIO]."""
    letters = F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    return F.octet_length(s).between(3, 32) & letters.isin(*w.BLANK_SPEECH)


def title(s: Column, fallback: Column, most: int = 24) -> Column:
    """The first sentence without end marks, cut; the fallback if under 4 characters are left."""
    end = "".join("\\" + c if c in ".?" else c for c in w.SENTENCE_END)
    head = trim(F.regexp_replace(F.coalesce(F.get(sentences(trim(s)), F.lit(0)), F.lit("")), f"[{end}]", ""))
    return F.when(F.length(head) >= 4, F.substring(head, 1, most)).otherwise(fallback)


def speaker_label(speaker: Column, labels: Column) -> Column:
    """The label of a speaker: unknown below 0, by position, or numbered."""
    return F.when(speaker < 0, "未识别").otherwise(F.coalesce(F.get(labels, speaker), F.concat(F.lit("说话人"), (speaker + 1).cast("string"))))


def speaker_labels(count: Column) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit("说话人"), i.cast("string")))
    return F.when(count <= 1, F.array(F.lit("发言人"))).otherwise(many)


def target_sentences(n: Column, ratio: float, least: int, most: int) -> Column:
    return F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n * ratio)))).cast("int")
