"""Words of a text as every operator of this package sees them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words are runs of [^\x20\x09-\x0D]. On UTF-8 bytes, split() breaks at exactly
# these six characters and leaves all other white space inside words.
WORD_GAPS = b" \t\n\v\f\r"


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def count_of(data: bytes, characters: bytes) -> int:
    """How many of the ASCII ``characters`` are in the UTF-8 ``data``."""
    return len(data) - len(data.translate(None, characters))


def id_text(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def remainder_of_id(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(id_text(doc_id).cast("binary")) % folds
