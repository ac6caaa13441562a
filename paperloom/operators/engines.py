"""Registry of recognisers. An engine is made once per task and reads images in batches.

An engine has describe() and either read_batch(keys, images), one reading
each, or read(key, image). A batch that fails is read again image by image,
so one bad image costs only its own reading.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH = 8

_FACTORIES: dict[str, Callable] = {}


def register(name: str):
    def keep(factory):
        _FACTORIES[name] = factory
        return factory

    return keep


def load(name: str, **options):
    """The engine of that name; a ValueError names the known ones."""
    if name not in _FACTORIES:
        raise ValueError(f"unknown engine {name!r}, known: {', '.join(sorted(_FACTORIES))}")
    return _FACTORIES[name](**options)


@register("none")
class NullEngine:
    """Reads nothing: shows whether a fault is in the plumbing or in a recogniser."""

    def describe(self) -> dict:
        return {"engine": "none", "simulated": True}

    def read(self, key: str, image: np.ndarray) -> dict:
        return {"latex": "", "confidence": 0.0}


@register("simulated")
class SimulatedEngine:
    """A plausible reading that depends on the key alone."""

    def describe(self) -> dict:
        return {"engine": "simulated", "simulated": True}

    def read(self, key: str, image: np.ndarray) -> dict:
        rng = random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
        a, b = rng.randint(1, 99), rng.randint(1, 9)
        return {"latex": rng.choice([f"= {a}", f"{a} \\bmod {b}", f"2^{{{b}}} - 1"]), "confidence": round(0.5 + 0.5 * rng.random(), 4)}


def read_batch(reader, keys: list[str], images: list) -> list:
    """A reading, or the error, of each image; an image may itself be an error."""
    good = [i for i, x in enumerate(images) if not isinstance(x, Exception)]
    out = list(images)
    many = getattr(reader, "read_batch", None)
    if many is not None:
        try:
            got = many([keys[i] for i in good], [images[i] for i in good])
            if len(got) != len(good):
                raise ValueError(f"{len(got)} readings of {len(good)} images")
            for i, x in zip(good, got, strict=True):
                out[i] = x
            return out
        except Exception:  # read one by one to find the bad image
            pass
    for i in good:
        try:
            out[i] = many([keys[i]], [images[i]])[0] if many is not None else reader.read(keys[i], images[i])
        except Exception as e:
            out[i] = e
    return out


def recognise(expressions: DataFrame, engine: str, batch: int = BATCH, **options) -> DataFrame:
    """(line_uid, index, of, latex, confidence, simulated, error); a reading that fails is a row with an error, not a failed job."""
    schema = "line_uid string, index int, of int, latex string, confidence double, simulated boolean, error string"

    def image(r):
        try:
            if r.data is None:
                raise ValueError("no image")
            return np.frombuffer(r.data, dtype=np.uint8).reshape(int(r.height), int(r.width))
        except Exception as e:
            return e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = load(engine, **options)
        mark = bool(reader.describe()["simulated"])
        for pdf in batches:
            out = []
            rows = list(pdf.itertuples(index=False))
            for k in range(0, len(rows), batch):
                part = rows[k : k + batch]
                for r, got in zip(part, read_batch(reader, [f"{r.line_uid}/{r.index}" for r in part], [image(r) for r in part]), strict=True):
                    try:
                        if isinstance(got, Exception):
                            raise got
                        out.append((r.line_uid, r.index, r.of, got["latex"], float(got["confidence"]), mark, None))
                    except Exception as e:
                        out.append((r.line_uid, r.index, r.of, None, None, mark, str(e)[:200]))
            yield pd.DataFrame(out, columns=["line_uid", "index", "of", "latex", "confidence", "simulated", "error"])

    load(engine, **options)
    return expressions.select("line_uid", "index", "of", "height", "width", "data").mapInPandas(run, schema)
