import shutil

from metaloom.streaming import incremental as I
from metaloom.streaming import retries as R

SCHEMA = "key string, request string"


def asker(log):
    def ask(request, attempt, heat):
        with open(log, "a") as f:
            f.write(f"{request} {attempt} {heat:.1f}\n")
        return f"{request}!" if attempt > int(request[-1]) else "- a- a"

    return ask


def test_requests_are_asked_once_hotter_each_time_and_replays_change_nothing(spark, tmp_path):
    log, source, target, state = (str(tmp_path / x) for x in ("log", "in", "out", "state"))

    def go(rows):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        R.written(R.answered(I.follow(spark, source, SCHEMA), asker(log), lambda answer: answer.endswith("!")), target, state).awaitTermination()
        return {r.key: (r.answer, r.attempt, r.temperature, r.sound, r.asked, r.hits) for r in R.latest(spark, target).collect()}

    first = go([("a", "q0"), ("b", "q1"), ("b", "q1"), ("c", "q2"), ("d", "q5")])
    assert first == {"a": ("q0!", 1, 0.0, True, 1, 0), "b": ("q1!", 2, 0.1, True, 2, 0), "c": ("q2!", 3, 0.2, True, 3, 0), "d": ("- a- a", 3, 0.2, False, 3, 0)}
    asked = open(log).read().splitlines()
    assert sorted(asked) == sorted(["q0 1 0.0", "q1 1 0.0", "q1 2 0.1", "q2 1 0.0", "q2 2 0.1", "q2 3 0.2", "q5 1 0.0", "q5 2 0.1", "q5 3 0.2"])
    # Nothing new: nothing asked. Known ones again: sound answers come from the state, the others go on hotter.
    assert go([]) == first and len(open(log).read().splitlines()) == len(asked)
    again = go([("a", "q0"), ("c", "q2"), ("d", "q5"), ("e", "q0")])
    assert again["a"] == ("q0!", 1, 0.0, True, 1, 1) and again["c"][5] == 1 and again["e"][0] == "q0!"
    assert again["d"] == ("q5!", 3, 0.5, True, 6, 0)
    # The last batch is run again: its commit is taken away, as after a crash. Its folder is overwritten from the state before it.
    calls = len(open(log).read().splitlines())
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert go([]) == again and len(open(log).read().splitlines()) == calls + 4
    shutil.rmtree(target)
