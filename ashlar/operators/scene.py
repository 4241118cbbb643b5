"""Validity of scene parts as column expressions: the first fault as text, or null.

A scene's arrays are nested columns; indices are foreign keys into them, and a negative one means none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key of an entity -> the scene's array that it refers to.
LINKS = {"mesh": "meshes", "material": "materials", "skeleton": "skeletons", "animation": "animations", "audio": "audio_clips", "collision": "collisions"}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def mesh(m: Column) -> Column:
    """positions (x, y, z of each vertex), normals, uvs, indices (a list of triangles)."""
    n = F.floor(F.size(m["positions"]) / 3)
    return (
        F.when(F.size(m["positions"]) % 3 != 0, "positions are not triples")
        .when(n == 0, "no vertices")
        .when((F.size(m["normals"]) > 0) & (F.size(m["normals"]) != F.size(m["positions"])), "normals do not match positions")
        .when((F.size(m["uvs"]) > 0) & (F.floor(F.size(m["uvs"]) / 2) != n), "uvs do not match positions")
        .when((F.size(m["indices"]) < 3) | (F.size(m["indices"]) % 3 != 0), "indices are not triangles")
        .when(~F.forall(m["indices"], lambda i: (i >= 0) & (i < n)), "index out of range")
    )


def texture(t: Column) -> Column:
    """width, height, encoding, pixels (binary). Only pixels of the encoding ``rgba8`` have a known size."""
    size = t["width"].cast("bigint") * t["height"] * 4
    return F.when((t["width"] <= 0) | (t["height"] <= 0), "empty texture").when((t["encoding"] == "rgba8") & (F.octet_length(t["pixels"]) != size), "pixels do not match the size")


def material(m: Column) -> Column:
    """colour."""
    return F.when(~F.forall(m["colour"], _finite), "colour is not finite")


def skeleton(s: Column) -> Column:
    """names, parents (-1: root), binds (empty, or 16 values a joint).

    Each step doubles how far every joint looks up, so that after as many steps as the number of joints has bits only
    joints below a cycle have not reached a root.
    """
    n = F.size(s["parents"])
    rounds = F.sequence(F.lit(0), F.length(F.bin(n.cast("bigint"))))
    far = F.aggregate(rounds, s["parents"], lambda up, _: F.transform(up, lambda p: F.when(p < 0, F.lit(-1)).otherwise(F.get(up, p))))
    return (
        F.when(F.size(s["names"]) != n, "names do not match parents")
        .when((F.size(s["binds"]) > 0) & (F.size(s["binds"]) != 16 * n), "bind matrices do not match joints")
        .when(F.exists(F.transform(s["parents"], lambda p, i: (p < -1) | (p >= n) | (p == i)), lambda bad: bad), "parent is not another joint")
        .when(F.exists(far, lambda p: p >= 0), "joints form a cycle")
    )


def clip(a: Column) -> Column:
    """duration, joints (how many)."""
    return F.when(~_finite(a["duration"]) | (a["duration"] < 0), "bad duration").when(a["joints"] < 0, "negative joint count")


def audio(a: Column) -> Column:
    """rate, channels, samples."""
    return F.when((a["rate"] <= 0) | (a["channels"] <= 0), "no sample rate or no channels").when((F.size(a["samples"]) > 0) & (F.size(a["samples"]) % a["channels"] != 0), "samples do not fill frames")


def box(b: Column) -> Column:
    """low, high (three values each)."""
    good = F.forall(F.zip_with(b["low"], b["high"], lambda x, y: _finite(x) & _finite(y) & (x <= y)), lambda ok: ok)
    return F.when((F.size(b["low"]) != 3) | (F.size(b["high"]) != 3) | ~good, "bad box")


def _first(xs: Column, check) -> Column:
    return F.get(F.filter(F.transform(xs, check), lambda x: x.isNotNull()), F.lit(0))


def broken_links(s: Column) -> Column:
    """Whether an entity refers to a part that the scene does not have."""
    fits = lambda e, key: (e[key] < 0) | (e[key] < F.size(s[LINKS[key]]))

    def whole(e: Column) -> Column:
        out = fits(e, "mesh")
        for key in list(LINKS)[1:]:
            out = out & fits(e, key)
        return out

    return ~F.forall(s["entities"], whole)


def scene(s: Column) -> Column:
    """entities (a number for each key of LINKS), then the arrays; parts of animations, audio clips and collisions are not looked into."""
    return F.coalesce(F.when(broken_links(s), F.lit("entity refers to nothing")), _first(s["meshes"], mesh), _first(s["textures"], texture), _first(s["materials"], material), _first(s["skeletons"], skeleton))
