"""zstandard with raw-content dictionaries: how many bytes a text needs, given each dictionary."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import claim


class Sizer:
    """Compressed sizes of a text by dictionary; frames carry no header fields that all texts share."""

    def __init__(self, dictionaries: dict, level: int, min_match: int = 0):
        self.by: dict = {}
        for name, data in dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0, **({"min_match": min_match} if min_match else {}))
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.by[name] = zstandard.ZstdCompressor(dict_data=content, compression_params=params)

    def sizes(self, text: bytes) -> dict:
        return {name: len(c.compress(text)) for name, c in self.by.items()}


_MADE: dict[tuple, Sizer] = {}


def sizer(dictionaries: dict, level: int, min_match: int = 0) -> Sizer:
    """A Sizer, made once per worker process and set of dictionaries."""
    claim("zdict", _MADE.clear)
    key = (level, min_match, *sorted(dictionaries.items()))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Sizer(dictionaries, level, min_match)
    return _MADE[key]


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def drawn(doc_id: Column, share: Column) -> Column:
    """About this share of rows, by a hash of their id; the same rows in every run."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < share * (1 << 30)
