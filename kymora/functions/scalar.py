"""Column expressions for cleaning, angles, categories and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name parts and the bin widths of the comparison study.
CLIP_PREFIX = "AG_WT-"
CLIP_SUFFIX = "_crop"
COMBINED_SUFFIX = "_crop_riasegmentation_cleanedalignedsegments_sam_fiji_combined.csv"
GENERIC_SUFFIX = "_sam_fiji_combined.csv"
COMBINED_MARK = "_crop_riasegmentation_cleanedalignedsegments"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def parse_number(c: Column) -> Column:
    """Lenient numeric parse: anything unreadable becomes null."""
    return c.try_cast("double")


def side_corrected(angle: Column, side: Column) -> Column:
    """Mirror angles taken from the right side."""
    return F.when(side == "right", -angle).otherwise(angle)


def ventral_corrected(angle: Column, ventral: Column) -> Column:
    return F.when(ventral == -1, -angle).otherwise(angle)


def unify_human_angle(angle: Column, side: Column) -> Column:
    return F.when(side == "left", 180 - angle).otherwise(angle)


def unify_scaled_angle(x: Column) -> Column:
    return x * 90 + 90


def unify_shifted_angle(x: Column) -> Column:
    return x + 90


def angle_bin(x: Column, width: float) -> Column:
    """Right-closed bins over [0, 180] with 0 in the first; null outside."""
    return F.when(x.between(0, 180), F.greatest(F.lit(1), F.ceil(x / F.lit(width))).cast("long"))


def odor_category(angle: Column) -> Column:
    return F.when(angle.between(-10, 10), "straight").when(angle < -10, "in odor").when(angle > 10, "in buffer")


def amplitude_ratio(amplitude: Column, length: Column) -> Column:
    return F.try_divide(amplitude, length / 2)


def wavelength_excess(wavelength: Column, length: Column) -> Column:
    return F.try_divide(wavelength - length, length)


def scaled_clip(x: Column, divisor: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / F.lit(divisor)))


def volcano_distance(lfc: Column, p: Column) -> Column:
    """Distance in the volcano plane; p = 0 is infinitely far."""
    y = F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))
    return F.sqrt(lfc * lfc + y * y)


def severity(angle: Column) -> Column:
    a = F.abs(angle)
    return F.when(a < 80, "problematic").when(a > 90, "good").otherwise("borderline")


def touches_edge_strict(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    return (x == 0) | (y == 0) | (x + w == img_w) | (y + h == img_h)


def touches_edge(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    return (x <= 0) | (y <= 0) | (x + w >= img_w - 1) | (y + h >= img_h - 1)


def near_crop_edge(box: list[Column], crop: list[Column], image: list[Column], atol: float = 20.0) -> Column:
    """Some side lies at the crop border while that side is not at the image border."""
    offset = [crop[0], crop[1], crop[0], crop[1]]
    hit = F.lit(False)
    for b, o, c, i in zip(box, offset, crop, image):
        side = b + o
        hit = hit | ((F.abs(side - c) <= atol) & ~(F.abs(side - i) <= atol))
    return hit


def forced_switch(prev: Column, cur: Column) -> Column:
    """A sign change between two large angles that no animal can make."""
    change, smaller = F.abs(cur - prev), F.least(F.abs(prev), F.abs(cur))
    rule = ((smaller > 30) & (change > 120)) | ((smaller > 45) & (change > 90))
    return F.coalesce((prev * cur < 0) & rule, F.lit(False))


def switch_penalty(prev: Column, cur: Column) -> Column:
    change, smaller = F.abs(cur - prev), F.least(F.abs(prev), F.abs(cur))
    flips = prev * cur < 0
    return (
        F.when(flips & (smaller > 45) & (change > 90), 200)
        .when(flips & (smaller > 30) & (change > 60), 100)
        .otherwise(0)
    )


def continuity_score(prev: Column, cur: Column, bent: Column) -> Column:
    """Reward small steps, punish large steps and impossible switches; 0 without a predecessor."""
    change = F.abs(cur - prev)
    allowed = F.when(bent, F.when(F.abs(prev) > 60, 25).otherwise(40)).otherwise(20)
    excess = change - allowed
    step = F.when(excess <= 0, -excess).when(excess > 50, excess * -3).otherwise(excess * -2)
    return F.when(prev.isNull(), F.lit(0.0)).otherwise(step - switch_penalty(prev, cur))


def bend_bonus(angle: Column, bent: Column) -> Column:
    a = F.abs(angle)
    strong = (
        F.when(a > 120, 50).when(a > 100, 40).when(a > 90, 30).when(a > 70, 15).when(a < 50, -60).when(a < 70, -30)
    ).otherwise(0)
    return F.when(bent, strong).otherwise(F.when(a > 120, -40).when(a > 90, -15).otherwise(0))


def bent_scaled(angle: Column, bent: Column) -> Column:
    """Lift small angles of bent animals towards 90, at most 2.5-fold."""
    factor = F.least(90.0 / F.greatest(F.abs(angle), F.lit(30.0)), F.lit(2.5))
    lifted = F.greatest(F.lit(-160.0), F.least(F.lit(160.0), angle * factor))
    return F.when(bent & (F.abs(angle) < 60), lifted).otherwise(angle)


def bent_alternative(angle: Column, bent: Column) -> Column:
    """Largest of three scaled readings above 5 degrees, scaled again by size, capped at 175."""
    best = F.when(F.abs(angle * 1.6) > 5, angle * 1.6).otherwise(angle)
    a = F.abs(best)
    scale = F.when(a > 80, 1.4).when(a > 60, 1.6).when(a > 40, 1.8).otherwise(2.0)
    capped = F.greatest(F.lit(-175.0), F.least(F.lit(175.0), best * scale))
    return F.when(bent, F.when(a > 20, capped).otherwise(best)).otherwise(angle)


def clean_subject_name(name: Column, renames: dict[str, str] | None = None) -> Column:
    """Text between the fixed prefix and suffix, one letter group corrected, fixed renames."""
    part = F.element_at(F.split(name, CLIP_PREFIX, -1), 2)
    part = F.element_at(F.split(part, CLIP_SUFFIX, -1), 1)
    both = name.contains(CLIP_PREFIX) & name.contains(CLIP_SUFFIX)
    out = F.when(both, part).otherwise(name)
    out = F.replace(out, F.lit("MMG"), F.lit("MMH"))
    result = F.when(F.lit(False), out)
    for old, new in (renames or {}).items():
        result = result.when(out == old, new)
    return result.otherwise(out)


def file_parts(name: Column, sep: str = "-") -> list[Column]:
    """Viscosity, condition and id from the base name."""
    base = F.substring_index(name, "/", -1)
    return [F.split_part(base, F.lit(sep), F.lit(i)) for i in (1, 2, 3)]


def text_before(name: Column, sep: str = "_") -> Column:
    return F.substring_index(name, sep, 1)


def recording_of_combined_file(name: Column) -> Column:
    """Recording id from a combined file name, with two fallbacks."""
    base = F.substring_index(name, "/", -1)
    stem = F.substring(base, F.lit(1), F.length(base) - len(COMBINED_SUFFIX))
    rest = F.regexp_extract(stem, r"^[^-]*-(?s:(.*))$", 1)
    full = F.when(stem.contains("-"), rest).otherwise(stem)
    guess = F.substring(base, F.lit(1), F.length(base) - len(GENERIC_SUFFIX))
    grest = F.regexp_extract(guess, r"^[^-]*-(?s:(.*))$", 1)
    return (
        F.when(base.endswith(COMBINED_SUFFIX), full)
        .when(
            base.endswith(GENERIC_SUFFIX) & guess.contains("-") & grest.contains(COMBINED_MARK),
            F.substring_index(grest, COMBINED_MARK, 1),
        )
        .otherwise(F.substring_index(base, "_", 1))
    )


def sample_of_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*\.(.+)_sorted\.bam$", "$1")


def condition_pair(name: Column) -> list[Column]:
    """Compared and reference condition, by position from the end of the file name."""
    parts = F.split(F.regexp_replace(name, r"\.csv$", ""), "_")
    return [F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-1))]


def decode_bytes_literal(c: Column) -> Column:
    return F.when(c.rlike("^b'.*'$"), F.regexp_extract(c, "^b'(.*)'$", 1)).otherwise(c)


def parse_array_literal(c: Column) -> Column:
    body = F.trim(F.regexp_replace(c, r"[\[\]]", " "))
    parts = F.filter(F.split(body, r"\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))


def wrapped_angle(head_y: Column, head_x: Column, body_y: Column, body_x: Column) -> Column:
    """Angle from body to head vector by difference of directions, in (-180, 180]."""
    d = F.degrees(F.atan2(head_y, head_x)) - F.degrees(F.atan2(body_y, body_x))
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def signed_angle(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """atan2(cross, dot) of two vectors in degrees."""
    return F.degrees(F.atan2(y1 * x2 - x1 * y2, y1 * y2 + x1 * x2))


def angle_at(ay: Column, ax: Column, by: Column, bx: Column, cy: Column, cx: Column) -> Column:
    """Angle at the middle of three points, degrees."""
    uy, ux, vy, vx = ay - by, ax - bx, cy - by, cx - bx
    norm = F.sqrt(uy * uy + ux * ux) * F.sqrt(vy * vy + vx * vx)
    cos = F.try_divide(uy * vy + ux * vx, norm)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def xyxy_to_xywh(box: list[Column]) -> list[Column]:
    x0, y0, x1, y1 = box
    return [x0, y0, x1 - x0, y1 - y0]


def uncrop_box(box: list[Column], crop: list[Column]) -> list[Column]:
    x0, y0 = crop[0], crop[1]
    return [box[0] + x0, box[1] + y0, box[2] + x0, box[3] + y0]


def uncrop_point(point: list[Column], crop: list[Column]) -> list[Column]:
    return [point[0] + crop[0], point[1] + crop[1]]


def part_of(index: Column, total: Column, parts: int = 6) -> Column:
    """Which of ``parts`` slices [i*n//parts, (i+1)*n//parts) a 0-based position falls in."""
    return F.floor(((index + 1) * parts - 1) / total).cast("long")


#: Pixel codes are y * PIXEL_SHIFT + x.
PIXEL_SHIFT = 1 << 20


def pixel_code(y: Column, x: Column) -> Column:
    """One number for a pixel, in raster order; a column outside 0 ... PIXEL_SHIFT - 1 is an error."""
    code = y.cast("long") * PIXEL_SHIFT + x
    return F.when((x >= 0) & (x < PIXEL_SHIFT), code).when(x.isNotNull(), F.raise_error(F.concat(F.lit("pixel column out of range: "), x.cast("string"))).cast("long"))
