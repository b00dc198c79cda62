import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_rows import awkward_rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with further columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("text_key size score labels copies target taken kept no_id block part node label lang_pred rejected n_words "
             "held_out seed start doc key row place n at site h1 _doc _key").split()
    return awkward.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
