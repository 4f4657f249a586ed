"""Scalar functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- bits ----------------------------------------------------------------------------------


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers in 16 hex digits. Halves, as the top bit doesn't fit a signed cast."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).cast("long")


# ---- vectors -------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, floor: float = 0.0) -> Column:
    """v over its norm; a zero vector stays, unless a floor for the norm is given."""
    norm = F.sqrt(dot(v, v))
    by = F.greatest(norm, F.lit(floor)) if floor else F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(v, lambda x: x / by)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


# ---- boxes ---------------------------------------------------------------------------------


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2); 0 if the union is empty."""
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    both = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def normalized_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """x1, y1, x2, y2 as parts of the picture; null where its size is unknown or zero."""
    known = (width > 0) & (height > 0)
    return [F.when(known, c / by) for c, by in ((x, width), (y, height), (x + w, width), (y + h, height))]


def crop_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float) -> list[Column]:
    """The box grown by a margin on each side, cut to the picture, in whole pixels."""
    return [F.greatest(F.floor(x - w * margin), F.lit(0)), F.greatest(F.floor(y - h * margin), F.lit(0)), F.least(F.ceil(x + w * (1 + margin)), width), F.least(F.ceil(y + h * (1 + margin)), height)]


def letterbox(width: Column, height: Column, side: int) -> list[Column]:
    """Scale and the left and top padding that centre a picture in a square."""
    ratio = F.least(F.lit(side) / width, F.lit(side) / height)
    return [ratio, *((F.lit(side) - F.bround(c * ratio)) / 2 for c in (width, height))]


def units(x: Column, digits: int) -> Column:
    """x >= 0 in units of that many digits after the point, as a long: the double's exact value, ties to even.

    Built-in rounding takes the shortest decimal that reads as the double, so 1.05, which lies above the tie, would tie. Parts below 2**-58 are cut off.
    """
    x = x.cast("double")
    whole, one = F.floor(x), F.lit(1 << 58).cast("decimal(19,0)")
    twice = ((x - whole) * float(1 << 58)).cast("long").cast("decimal(19,0)") * F.lit(2 * 10**digits).cast("decimal(12,0)")
    halves, over = F.call_function("div", twice, one), (twice % one) > 0
    low = F.floor(halves / 2).cast("long")
    odd = low + whole.cast("long") * 10**digits
    up = (halves % 2 == 1) & (over | (odd % 2 == 1))
    return odd + up.cast("long")


def one_digit(x: Column) -> Column:
    """x >= 0 with one digit after the point, as text."""
    tenths = units(x, 1)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def scale_plan(width: Column, height: Column, scales: Column, most: int) -> Column:
    """Scales with none that takes the long side past `most`, in four digits, positive, each once, in order."""
    cap = F.try_divide(F.lit(float(most)), F.greatest(width, height))
    return F.array_distinct(F.filter(F.transform(scales, lambda s: units(F.least(s, cap), 4) / 10_000), lambda s: s > 0))


# ---- texts ---------------------------------------------------------------------------------


def human_duration(s: Column) -> Column:
    """Seconds below a minute (rounded, half to even), minutes and seconds below an hour, else hours and minutes; nothing below 0."""
    s = F.greatest(s.cast("double"), F.lit(0.0))
    whole = F.floor(s)
    short = F.format_string("%ds", F.bround(s, 0).cast("long"))
    return F.when(s < 60, short).when(s < 3600, F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))


def human_rate(per_second: Column) -> Column:
    """One digit after the point, half to even, a minute below one a second; 0/s for nothing or less."""
    return F.when(per_second >= 1, F.concat(one_digit(per_second), F.lit("/s"))).when(per_second > 0, F.concat(one_digit(per_second * 60), F.lit("/min"))).otherwise("0/s")


def human_bytes(n: Column) -> Column:
    """Up to 1023 whole bytes, then one digit after the point, half to even."""
    n = n.cast("double")
    out = F.concat(one_digit(n / 1024**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.concat(one_digit(n / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def console_line(raw: Column) -> Column:
    """The last frame between carriage returns that isn't blank, without colour codes and trailing blanks."""
    plain = F.regexp_replace(raw, "\x1b\\[[0-9;?]*[A-Za-z]", "")
    frames = F.filter(F.split(plain, "\r"), lambda x: F.trim(x) != "")
    return F.coalesce(F.rtrim(F.try_element_at(frames, F.lit(-1))), F.lit(""))


def crop_path(face_id: Column, context: bool = False) -> Column:
    """Sharded by the id's low byte, in hex."""
    return F.concat(F.format_string("%02x", F.pmod(face_id, F.lit(256))), F.lit("/"), face_id.cast("string"), F.lit("_ctx.jpg" if context else ".jpg"))


def crop_url(path: Column, root: str) -> Column:
    """Path under root as a URL path; null outside."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.concat(F.lit("/crops/"), F.substring(path, len(root) + 1, 1 << 30)))


def item_url(base: Column, space: Column, item: Column, fallback: str = "http://localhost:5000") -> Column:
    base = F.rtrim(F.coalesce(F.when(F.trim(base) != "", base), F.lit(fallback)), F.lit("/"))
    return F.concat(base, F.lit("/?launchApp=SYNO.Foto.AppInstance#/"), space, F.lit("_space/timeline/item/"), item.cast("string"))


def failure_reason(lines: Column, exit_code: Column | None = None, most: int = 500) -> Column:
    """The last line of an error text that is neither indented nor scaffolding, else the last that isn't blank, else the exit code."""
    some = F.filter(F.split(lines, "\n"), lambda x: ~x.rlike(r"^\s*$"))
    said = F.filter(some, lambda x: ~x.rlike(r"^[ \t]|^\s*(Traceback \(|\^|~)"))
    last = lambda found: F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"^\s+|\s+$", "")
    code = F.coalesce(exit_code.cast("string") if exit_code is not None else F.lit(None).cast("string"), F.lit("None"))
    return F.coalesce(F.substring(F.coalesce(last(said), last(some)), 1, most), F.concat(F.lit("exited with code "), code, F.lit(" and no output")))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def version_hash(manifest: Column, settings: Column) -> Column:
    return F.substring(F.sha2(F.concat(manifest, settings), 256), 1, 12)


# ---- JSON payloads -------------------------------------------------------------------------


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def named_merge(payload: Column) -> Column:
    """Both sides of a merge have a name."""
    return ~blank(F.get_json_object(payload, "$.person_a.name")) & ~blank(F.get_json_object(payload, "$.person_b.name"))


def payload_faces(payload: Column) -> Column:
    """All face ids that a payload refers to, each once: face_id, face_ids, and exemplars of the evidence. Junk is skipped."""
    at = lambda path: F.get_json_object(payload, path)
    many = F.coalesce(F.from_json(at("$.face_ids"), "array<string>"), F.array().cast("array<string>"))
    shown = F.coalesce(F.flatten(F.map_values(F.from_json(at("$.evidence.exemplars"), "map<string,array<string>>"))), F.array().cast("array<string>"))
    every = F.concat(F.array(at("$.face_id")), many, shown)
    return F.array_distinct(F.filter(F.transform(every, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))
