"""What a file or an entry is, by its first bytes and by its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binexpr import clamped, exact

# Signature (hex), name, family, in order of precedence.
SIGNATURES = (
    ("89504E470D0A1A0A", "png", "texture"),
    ("FFD8FF", "jpeg", "texture"),
    ("474946383761", "gif", "texture"),
    ("474946383961", "gif", "texture"),
    ("424D", "bmp", "texture"),
    ("44445320", "dds", "texture"),
    ("AB4B5458203230BB0D0A1A0A", "ktx2", "texture"),
    ("AB4B5458203131BB0D0A1A0A", "ktx", "texture"),
    ("52494646", "riff", "container"),
    ("4F676753", "ogg", "audio"),
    ("664C6143", "flac", "audio"),
    ("494433", "id3", "audio"),
    ("504B0304", "zip", "archive"),
    ("504B0506", "zip", "archive"),
    ("1F8B", "gzip", "compression"),
    ("425A68", "bzip2", "compression"),
    ("FD377A585A00", "xz", "compression"),
    ("28B52FFD", "zstd", "compression"),
    ("377ABCAF271C", "7z", "archive"),
)
AFTER_ZLIB = (("1B4C7561", "lua-bytecode", "script"), ("3C3F786D6C", "xml", "document"))

# Text in a file -> graphics interface.
GRAPHICS = (
    ("d3d9.dll", "directx9"), ("d3d11.dll", "directx11"), ("d3d11createdevice", "directx11"), ("d3d12.dll", "directx12"),
    ("d3d12createdevice", "directx12"), ("dxgi.dll", "directxgi"), ("opengl32.dll", "opengl"), ("libglesv2", "opengles"),
    ("libegl", "opengles"), ("vulkan-1.dll", "vulkan"), ("vkcreateinstance", "vulkan"), ("metal.framework", "metal"),
    ("mtlcreatesystemdefaultdevice", "metal"),
)
# Text in the name of an imported library -> graphics interface.
IMPORTS = (
    ("d3d9.dll", "directx9"), ("d3d11.dll", "directx11"), ("d3d12.dll", "directx12"), ("dxgi.dll", "directxgi"), ("opengl32.dll", "opengl"),
    ("libglesv2", "opengles"), ("libegl", "opengles"), ("vulkan-1.dll", "vulkan"), ("metal.framework", "metal"),
)

GRAPHICS_BYTES = 4 << 20


def _starts(content: Column, digits: str) -> Column:
    return F.startswith(content, F.lit(bytes.fromhex(digits)))


def is_zlib(content: Column) -> Column:
    """Deflate, a window of 32 KiB at most, and a header that 31 divides."""
    head = F.conv(F.hex(exact(content, 0, 2)), 16, 10).cast("int")
    first = F.expr("0") + F.floor(head / 256).cast("int")
    return F.coalesce((first.bitwiseAND(F.lit(15)) == 8) & (F.shiftright(first, 4) <= 7) & (head % 31 == 0), F.lit(False))


def _case(content: Column, pick) -> Column:
    wave = _starts(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645")
    out = None
    for digits, name, family in SIGNATURES:
        if name == "riff":
            out = out.when(wave, pick("wav", "audio"))
        found = _starts(content, digits)
        out = F.when(found, pick(name, family)) if out is None else out.when(found, pick(name, family))
    out = out.when(is_zlib(content), pick("zlib", "compression"))
    for digits, name, family in AFTER_ZLIB:
        out = out.when(_starts(content, digits), pick(name, family))
    return out.otherwise(pick("unknown", "unknown"))


def format_of(content: Column) -> Column:
    """Name of the first signature that fits, or ``unknown``."""
    return _case(content, lambda name, family: F.lit(name))


def family_of(content: Column) -> Column:
    return _case(content, lambda name, family: F.lit(family))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_extension(name: Column) -> Column:
    """From the last dot on, in lower case; ``(none)`` without a dot or with one at the end. Folders are not cut off, and a name that starts with its only dot is its extension."""
    return F.when(~F.contains(name, F.lit(".")) | F.endswith(name, F.lit(".")), F.lit("(none)")).otherwise(ascii_lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))))


def path_extension(path: Column) -> Column:
    """Of the last component; ``(none)`` too if its only dot comes first."""
    base = F.regexp_extract(path, "([^/\\\\]*)$", 1)
    stem = F.instr(base, ".")
    last = F.length(base) - F.length(F.substring_index(base, ".", -1))
    return F.when((stem == 0) | (last == 1) | F.endswith(base, F.lit(".")), F.lit("(none)")).otherwise(ascii_lower(F.concat(F.lit("."), F.substring_index(base, ".", -1))))


def printed_name(raw: Column) -> Column:
    """Bytes up to the first zero, what cannot be printed as ``?``."""
    text = F.substring_index(F.decode(raw, "ISO-8859-1"), "\0", 1)
    return F.regexp_replace(text, "[^ -~]", "?")


def text_or_latin(raw: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))


def looks_like_text(content: Column) -> Column:
    """The first 64 bytes at most: tab, line feed, carriage return, or 32 and above but 127."""
    return F.regexp_like(F.decode(clamped(content, 0, 64), "ISO-8859-1"), F.lit("^[\\t\\n\\r\\x20-\\x7E\\x80-\\xFF]*$"))


def label_entry(content: Column, stored: Column) -> Column:
    """``empty``, ``unreadable``, ``packed:XXXX``, a format, ``text`` or ``bin``."""
    magic = exact(content, 0, 4)
    packed = F.concat(F.lit("packed:"), F.regexp_replace(F.decode(magic, "ISO-8859-1"), "[^ -~]", "."))
    found = format_of(content)
    return (
        F.when(content.isNull(), F.lit("unreadable"))
        .when(F.octet_length(content) == 0, F.lit("empty"))
        .when(~stored, F.coalesce(packed, F.lit("unreadable")))
        .when(found != "unknown", found)
        .when(looks_like_text(content), F.lit("text"))
        .otherwise(F.lit("bin"))
    )


def _named(text: Column, patterns: tuple) -> Column:
    """(pattern, api) of the patterns that ``text`` has, in their order."""
    found = F.array(*[F.when(F.contains(text, F.lit(p)), F.struct(F.lit(p).alias("pattern"), F.lit(api).alias("api"))) for p, api in patterns])
    return F.filter(found, lambda x: x.isNotNull())


def graphics_in(content: Column, patterns: tuple = GRAPHICS, most: int | None = GRAPHICS_BYTES) -> Column:
    """Interfaces named in the first ``most`` bytes (None: in all), in the order of the patterns (UTF-8); plain OpenGL goes where OpenGL ES is named."""
    latin = tuple((p.encode().decode("latin-1"), api) for p, api in patterns)
    text = ascii_lower(F.decode(content if most is None else clamped(content, 0, most), "ISO-8859-1"))
    found = F.array_distinct(F.transform(_named(text, latin), lambda x: x["api"]))
    return F.when(F.array_contains(found, "opengles"), F.filter(found, lambda x: x != "opengl")).otherwise(found)


def graphics_evidence(content: Column) -> Column:
    """The patterns themselves; those of an interface that :func:`graphics_in` drops go as well."""
    text = ascii_lower(F.decode(clamped(content, 0, GRAPHICS_BYTES), "ISO-8859-1"))
    found = _named(text, GRAPHICS)
    es = F.exists(found, lambda x: x["api"] == "opengles")
    return F.transform(F.filter(found, lambda x: ~(es & (x["api"] == "opengl"))), lambda x: x["pattern"])


def imported_graphics(libraries: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(libraries, lambda name: F.transform(_named(ascii_lower(name), IMPORTS), lambda x: x["api"]))))


def imported_evidence(libraries: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(libraries, lambda name: F.transform(_named(ascii_lower(name), IMPORTS), lambda x: F.concat(x["pattern"], F.lit(" import"))))))


def compression_name(code: Column) -> Column:
    return F.when(code == 0, F.lit("stored")).when(code == 2, F.lit("LZ2K")).otherwise(F.lit("unknown"))


def format_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """``N B``, or one decimal of the largest binary unit that fits; null for null.

    As printf rounds: the exact value, a half to the even digit. The fraction of a whole number of bytes has 40 bits
    at most, so its tenfold is exact; the JVM's own ``%.1f`` rounds a half up.
    """
    out = F.when(n.isNull(), F.lit(None).cast("string")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units):
        value = n.cast("double") / float(1024 ** (k + 1))
        whole = F.floor(value)
        text = F.format_string(f"%.1f {unit}", whole + F.rint((value - whole) * 10) / 10)
        out = out.otherwise(text) if unit == units[-1] else out.when(n < 1024 ** (k + 2), text)
    return out


def parse_extensions(text: Column) -> Column:
    """Comma list -> distinct extensions with a dot before them, in lower case."""
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: ascii_lower(F.when(F.startswith(x, F.lit(".")), x).otherwise(F.concat(F.lit("."), x)))))


def parse_count(text: Column) -> Column:
    """Decimal digits as an unsigned 64-bit number, else null."""
    value = F.when(F.regexp_like(text, F.lit("^[0-9]+$")), text.try_cast("decimal(38,0)"))
    return F.when(value < F.lit("18446744073709551616").cast("decimal(38,0)"), value.cast("decimal(20,0)"))


def half_to_float(h: Column) -> Column:
    """IEEE half precision, subnormal numbers, infinities and NaN included."""
    sign = F.when(h.bitwiseAND(F.lit(0x8000)) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(h, 10).bitwiseAND(F.lit(31))
    fraction = h.bitwiseAND(F.lit(1023))
    return (
        F.when(exponent == 0, sign * fraction * F.lit(2.0**-24))
        .when((exponent == 31) & (fraction == 0), sign * F.lit(float("inf")))
        .when(exponent == 31, F.lit(float("nan")))
        .otherwise(sign * F.pow(F.lit(2.0), (exponent - 15).cast("double")) * (1 + fraction / 1024.0))
    )


def path_check(path: Column) -> Column:
    """Why a relative path cannot be written anywhere, or null if it can: the first fault from left to right.

    A component's characters come before the component as a whole. Lengths are in bytes.
    """
    parts = F.split(path, "[/\\\\]")
    device = "^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
    fault = lambda p: (
        F.when(F.regexp_like(p, F.lit("[^ -~]|[<>:\"|?*]")), F.lit("forbidden character"))
        .when(p.isin("", ".", ".."), F.lit("empty or dot component"))
        .when(F.regexp_like(p, F.lit("[ .]$")), F.lit("trailing space or dot"))
        .when(F.regexp_like(F.substring_index(p, ".", 1), F.lit(device)), F.lit("reserved name"))
    )
    return (
        F.when(path.isNull() | ~F.octet_length(path).between(1, 240), F.lit("empty or too long"))
        .when(F.regexp_like(path, F.lit("^[/\\\\]")), F.lit("absolute path"))
        .otherwise(F.get(F.filter(F.transform(parts, fault), lambda x: x.isNotNull()), F.lit(0)))
    )


def detail_row(e: dict[str, Column]) -> Column:
    """One line for an entry of a catalogue: id, compression_code, stored_size, original_size, offset, in_bounds."""
    code = e["compression_code"]
    packed = F.concat(compression_name(code), F.lit("  "), format_bytes(e["stored_size"]), F.lit(" -> "), format_bytes(e["original_size"]))
    packed = F.when(code == 2, packed).otherwise(F.concat(packed, F.lit(" (code "), code.cast("string"), F.lit(")")))
    size = F.when(code == 0, F.concat(F.lit("stored  "), format_bytes(e["stored_size"]))).otherwise(packed)
    return F.concat(F.lit("#"), e["id"].cast("string"), F.lit("  "), size, F.lit("  @0x"), F.hex(e["offset"].cast("bigint")), F.when(e["in_bounds"], F.lit("")).otherwise(F.lit("  out of bounds")))
