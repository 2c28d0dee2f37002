from crystalspark.plans import catalog


def test_descriptors_have_the_operators_width(spark):
    found = catalog.queries()["pdd_descriptors"](spark, "/root/testdata/sf0.001")
    assert {len(r.distances) for r in found.select("distances").collect()} == {100}
