"""What the driver gives back between the phases of an operator."""

from pathloom.llm import pii
from pathloom.llm.scratch import release


def resident_mb(pid):
    with open(f"/proc/{pid}/status") as status:
        return next(int(line.split()[1]) for line in status if line.startswith("VmRSS")) / 1024


def test_freed_native_memory_goes_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    # the last one stays, on top of what the others leave
    for deflater in held[:-1]:
        deflater.end()
    for _ in range(3):
        jvm.System.gc()
    before = resident_mb(pid)
    release(spark)
    assert before - resident_mb(pid) > 50
    held[-1].end()


def test_masking_releases_between_phases(spark, monkeypatch):
    released = []
    monkeypatch.setattr(pii, "release", lambda session: released.append(session))
    rows = pii.mask_pii(spark.createDataFrame([(1, "mail a@b.de", 11)], "doc_id long, text string, n_chars long")).collect()
    assert [tuple(r) for r in rows] == [(1, "mail [EMAIL]", 12)]
    assert len(released) >= 4
