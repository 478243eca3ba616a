import public_tokenizers
import pyarrow as pa

from evalscale.llm import common
from evalscale.llm import op1_pack as op


def test_the_encoder_forgets_words_before_they_take_much_memory():
    assert op.CACHE_WORDS <= 300_000 and op.CACHE_CHARS <= 24 << 20 and op.TEXT_BYTES <= 3 << 20
    small, large = (op.Encoder(public_tokenizers.path("word_bpe_49k.json"), n) for n in (50, 10_000))
    for i in range(20):
        column = pa.array([f"w{i}x{j} again, w{j}!" for j in range(30)])
        got, want = small.encode(column), large.encode(column)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and small.known <= 150


def test_batches_to_python_are_modest(spark):
    common.modest_batches(spark)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    assert 0 < size <= 4 << 20
