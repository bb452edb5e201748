"""Scalar functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# Kilometres per degree, and travel cost by land cover class.
KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.320, 110.574
LAND_COST = {0: 1e6, 10: 1.6, 20: 1.3, 30: 1.0, 40: 1.1, 50: 2.0, 60: 1.0, 70: 3.0, 80: 50.0, 90: 3.0, 95: 5.0, 100: 1.2}


def unit(*parts) -> Column:
    """A number in (0, 1) from the md5 of the parts (columns, numbers or text), joined by colons: the same in any engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def div(a: Column, b) -> Column:
    """Whole quotient, rounded down, of numbers that aren't negative."""
    return F.floor(a / b).cast("long")


def blocks_across(width: Column, block: Column) -> Column:
    return F.ceil(width / block).cast("int")


def block_id(bx: Column, by: Column, nbx: Column) -> Column:
    return by * nbx + bx


def prefix_length(count: Column, deep: Column, rows: Column, margin: float, least: int) -> Column:
    """Compressed bytes that should hold the rows down to `deep` of a block of `rows` rows."""
    want = count * ((deep + 1).cast("double") / rows + F.lit(float(margin)))
    return F.least(count.cast("double"), F.greatest(F.lit(float(least)), want)).cast("long")


def restart_length(count: Column, in_byte: Column, bits: Column, out: Column, target: Column, total: Column, margin: float, least: int) -> tuple[Column, Column]:
    """First byte within the block, and bytes from it, to decode from a restart point up to `target`."""
    first = in_byte - F.when(bits > 0, 1).otherwise(0)
    want = count * ((target - out).cast("double") / total + F.lit(float(margin)))
    return first, F.least((count - first).cast("double"), F.greatest(F.lit(float(least)), want)).cast("long")


def restart_span(csize: Column, total: Column, share: float, window: int = 32768) -> Column:
    """Output bytes between restart points whose windows take `share` of the compressed size; null where not one fits."""
    n = F.floor(F.lit(float(share)) * csize / window)
    return F.when(n >= 1, F.greatest(F.lit(window).cast("long"), F.floor(total / n).cast("long")))


def to_pixel(x: Column, y: Column, t: list[Column]) -> tuple[Column, Column]:
    """World to pixel by an affine (a, b, c, d, e, f) without rotation."""
    return F.floor((x - t[2]) / t[0]).cast("long"), F.floor((y - t[5]) / t[4]).cast("long")


def to_world(px: Column, py: Column, t: list[Column]) -> tuple[Column, Column]:
    """The centre of a pixel."""
    return t[2] + (px + 0.5) * t[0], t[5] + (py + 0.5) * t[4]


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def km_per_degree(lat: Column) -> tuple[Column, Column]:
    return F.lit(KM_PER_DEGREE_LON) * F.cos(F.radians(lat)), F.lit(KM_PER_DEGREE_LAT)


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing on the WGS 84 ellipsoid, by the sixth-order transverse Mercator series."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = (f * (2 - f)) ** 0.5
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = 0.9996 * radius
    return 500000.0 + scale * east, F.when(south, 10000000.0).otherwise(0.0) + scale * north


def slope_degrees(gx: Column, gy: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(45.0), F.degrees(F.atan(F.hypot(gx, gy)))))


def land_cost(kind: Column, costs: dict[int, float] | None = None, default: float = 1.5) -> Column:
    table = LAND_COST if costs is None else costs
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[kind.cast("int")], F.lit(default))


def cell_cost(kind: Column, slope: Column, bad: Column) -> Column:
    """Infinite where the height is unknown."""
    return F.when(bad, F.lit(float("inf"))).otherwise(land_cost(kind) * (1 + 0.08 * slope))


def bad_height(v: Column, nodata: Column) -> Column:
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | F.coalesce(v == nodata, F.lit(False))


def ndvi(red: Column, nir: Column) -> Column:
    total = (nir + red).cast("double")
    return F.when(total > 0, (nir - red) / F.greatest(total, F.lit(1.0))).otherwise(0.0).cast("float")


def range_bounds(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte of a Range header; of several ranges the first; null where it isn't one."""
    lo, hi = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)", 2)
    lo, hi = F.when(lo != "", lo.cast("long")), F.when(hi != "", hi.cast("long"))
    return F.when(lo.isNotNull(), lo).when(hi.isNotNull(), F.greatest(F.lit(0).cast("long"), size - hi)), F.when(lo.isNotNull(), F.coalesce(hi, size - 1)).when(hi.isNotNull(), size - 1)


def content_range(header: Column) -> tuple[Column, Column, Column]:
    """First byte, last byte and size of a Content-Range header; null where it isn't whole."""
    return tuple(F.when(header.rlike(r"^bytes (\d+)-(\d+)/(\d+)$"), F.regexp_extract(header, r"^bytes (\d+)-(\d+)/(\d+)$", i).cast("long")) for i in (1, 2, 3))


def downloads(line: Column) -> Column:
    """Ranges that a debug line tells of, as array of first-last."""
    return F.regexp_extract_all(line, F.lit(r"(?i)(?:S3|VSIS3|VSICURL)\s*:\s*Downloading\s+(\d+-\d+)"), 1)


def request_kind(method: Column, query: Column, key: Column, ranged: Column) -> Column:
    listing = F.coalesce(query, F.lit("")).contains("list-type") | ((method == "GET") & (F.coalesce(key, F.lit("")) == ""))
    return F.when(listing, "LIST").otherwise(F.concat(method, F.when(ranged, "_RANGE").otherwise("")))


def identity(version: Column, etag: Column) -> Column:
    """version-id unless there is none, else the ETag, else null."""
    tag = F.trim(etag)
    return F.when(version.isNotNull() & (version != "") & (version != "null"), F.concat(F.lit("version-id:"), version)).when(tag != "", F.concat(F.lit("etag:"), tag))


def object_path(bucket: Column, key: Column) -> Column:
    """/bucket/key with every byte but letters, digits, _.-~ and / escaped."""
    escaped = F.regexp_replace(F.url_encode(F.concat_ws("/", bucket, key)), r"\+", "%20")
    for a, b in (("%2F", "/"), ("%7E", "~"), (r"\*", "%2A")):
        escaped = F.regexp_replace(escaped, a, b)
    return F.concat(F.lit("/"), escaped)


def key_parts(key: Column) -> dict[str, Column]:
    """Pieces of a path such as bucket/tile/date/band.tif: bucket, object (what follows it), date, band."""
    parts = F.split(key, "/")
    n = F.size(parts)
    return {"bucket": parts[0], "object": F.substring(key, F.length(parts[0]) + 2, F.length(key)), "date": F.when(n > 2, F.element_at(parts, -2)), "band": F.regexp_extract(F.element_at(parts, -1), r"^([^.]*)", 1)}


def config_label(config: Column, labels: dict[str, str]) -> Column:
    """A configuration's name in reports; its own where there is none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[config], config)


def nodata_value(text: Column) -> Column:
    return F.trim(F.translate(text, "\0", " ")).try_cast("double")


def sparse_fill(nodata: Column) -> Column:
    return F.coalesce(nodata, F.lit(0.0))


def zlib_wrapped(data: Column) -> Column:
    """Whether bytes begin as a zlib stream does."""
    head = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    return (F.octet_length(data) >= 2) & (F.pmod(F.floor(head / 256), F.lit(16)) == 8) & (head % 31 == 0)


def headroom_pct(amplification: Column) -> Column:
    return (1 - F.try_divide(F.lit(1.0), amplification)) * 100


def run_tag(workload: Column, config: Column, rtt: Column, bandwidth: Column) -> Column:
    return F.concat_ws(".", workload, config, F.concat(F.lit("rtt"), rtt.cast("int").cast("string")), F.when(bandwidth > 0, F.concat(F.lit("bw"), bandwidth.cast("int").cast("string"))))


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def cell_name(lat: Column, lon: Column) -> Column:
    """A degree cell's name, as N47E011."""
    part = lambda v, pos, neg, n: F.concat(F.when(v < 0, neg).otherwise(pos), F.lpad(F.abs(v).cast("string"), n, "0"))
    return F.concat(part(lat, "N", "S", 2), part(lon, "E", "W", 3))


def parse_cell(name: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a name such as N47E011."""
    lat, lon = F.regexp_extract(name, r"[NS](\d{2})", 1).cast("int"), F.regexp_extract(name, r"[EW](\d{3})", 1).cast("int")
    return F.when(name.rlike(r"S\d{2}"), -lat).otherwise(lat), F.when(name.rlike(r"W\d{3}"), -lon).otherwise(lon)


def size_text(n: Column) -> Column:
    """A number of bytes as people write it."""
    return F.when(n >= 10**9, F.concat(F.format_number(n / 1e9, 2), F.lit(" GB"))).when(n >= 10**6, F.concat(F.format_number(n / 1e6, 1), F.lit(" MB"))).when(n >= 10**3, F.concat(F.format_number(n / 1e3, 0), F.lit(" kB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
