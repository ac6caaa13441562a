"""Keys, file names and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_NAME = r"^s(\d+)_c(\d+)_p(\d+)(?:_b(\d+)_l(\d+))?\.png$"
CORPUS_PATH = r"^student_(\d+)/cie_(\d+)/page_(\d+)(?:/b(\d+)_l(\d+))?\.png$"


def page_id(student: Column, cie: Column, page: Column) -> Column:
    return F.when(student.isNotNull() & cie.isNotNull() & page.isNotNull(), F.format_string("s%02d_c%d_p%02d", student, cie, page))


def line_uid(page: Column, block: Column, line: Column) -> Column:
    return F.when(page.isNotNull() & block.isNotNull() & line.isNotNull(), F.format_string("%s_b%02d_l%02d", page, block, line))


def path_part(path: Column, pattern: str, k: int) -> Column:
    """The k-th number of a path that has the pattern, null for any other path."""
    part = F.regexp_extract(path, pattern, k)
    return F.when(part != "", part.try_cast("int"))


def corpus_path(file_name: Column) -> Column:
    """sNN_cC_pPP.png -> student_NN/cie_C/page_PP.png, null for other names."""
    return F.when(file_name.rlike(FILE_NAME), F.regexp_replace(file_name, r"^s(\d+)_c(\d+)_p(\d+)\.png$", "student_$1/cie_$2/page_$3.png"))


def seed(uid: Column) -> Column:
    """First eight bytes of SHA-256 as an unsigned decimal string: the same whatever the row's position."""
    return F.conv(F.substring(F.sha2(uid, 256), 1, 16), 16, 10)


def uniform(uid: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.sha2(uid, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
