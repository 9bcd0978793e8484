"""Rendering and cutting SOAP sources is spread over tasks (host W)."""


from srcframe.sources.adapters import soap_files


def test_soap_files_are_dealt_out(spark):
    assert soap_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
