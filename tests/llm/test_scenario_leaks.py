from tapline.llm.scenario_leaks import find_leaks

ITEM = "After the scan Alice sent 20 packets to 10.0.0.1 in 20 seconds, then the sensor closed the flow with 300 MB."
OTHER = "how many flows did the second sensor keep open while the first one was being restarted by the operator"


def rows_of(df):
    return {(r.event_id, r.scenario_id): r for r in df.collect()}


def test_leaks(spark):
    scenarios = spark.createDataFrame([(1, ITEM, "x"), (2, OTHER, "x"), (3, None, "x"), (4, "", "x"), (5, "too short", "x"), (6, "exact five word scenario here", "x"), (7, OTHER, "x")], "scenario_id long, raw string, id string")
    changed = ITEM.replace("20", "35").replace("Alice", "Bob").replace("10.0.0.1", "192.168.7.9")
    broken = ITEM.replace("20 packets", "35 packets").replace("in 20", "in 77")
    pad = "unrelated words of a record that nobody asked about. "
    events = [
        (1, pad + ITEM + " " + pad, "x"), (2, pad + changed, "x"), (3, broken, "x"), (4, pad * 50, "x"), (5, None, "x"), (6, "", "x"), (7, OTHER.upper() + " end", "x"),
        (8, pad + "exact five word scenario here", "x"), (9, (pad + OTHER + ". ") * 200, "x"), (10, " ".join(OTHER.split()[:7]), "x"), (1, pad + ITEM + " " + pad, "x"),
    ]
    frame = spark.createDataFrame(events, "event_id long, raw string, window string")
    got = rows_of(find_leaks(frame, scenarios))
    assert set(got) == {(1, 1), (2, 1), (7, 2), (7, 7), (8, 6), (9, 2), (9, 7)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised and got[1, 1].percent > 80
    assert find_leaks(frame.limit(0), scenarios).count() == 0 and find_leaks(frame, scenarios.limit(0)).count() == 0


def test_brute_force(spark):
    """Without slots: a pair is found if and only if a run of equal words is long enough."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}x" for i in range(12)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: words(r.randint(9, 30)) for i in range(8)}
    docs = {}
    for d in range(60):
        item, n = items[d % 8], r.randint(6, 30)
        at = r.randint(0, max(0, len(item) - n))
        docs[d] = words(r.randint(0, 30)) + item[at : at + n] + words(r.randint(0, 30))

    def run(a, b):
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, k)
        return best

    want = {(d, i) for d, x in docs.items() for i, y in items.items() if (n := run(x, y)) >= 8 and (n >= 13 or 100 * n >= 50 * len(y))}
    got = find_leaks(
        spark.createDataFrame([(d, " ".join(x)) for d, x in docs.items()], "event_id long, raw string"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "scenario_id long, raw string"),
    )
    assert set(rows_of(got)) == want


def test_slots_of_changing_length(spark):
    """Names of other lengths, units apart or not, sentence starts, items of few plain words and split fragments."""
    items = [
        (1, "the train to Lima took 5 kg of mail and then Lima sent 7 kg back to the old port of Lima before night"),
        (2, "Alice has 5 apples. Bob has 7 apples. Carol has 9 apples. Dan has 11 apples."),
        (3, "Paris 12 London 14 Rome 16 Oslo 18"),
        (4, "one red two blue three green four white five black six pink seven brown eight grey nine violet ten gold end"),
    ]
    events = [
        (1, "the train to San Jose took 50kg of mail and then San Jose sent 70kg back to the old port of San Jose before night"),
        (2, "Anna Maria has 15 apples. Erik has 17 apples. Fay Lee has 19 apples. Gus has 21 apples."),
        (3, "so Paris 12 London 14 Rome 16 Oslo 18 it was"), (4, "so Paris 13 London 14 Rome 16 Oslo 18 it was"),
        (5, "the train to San Jose took 50kg of mail and then Quito sent 70kg back to the old port of Riga before night"),
        (6, "one red two blue three green four white NEW five black six pink seven brown eight grey"),
        (7, "one red two blue three green four white and nothing more of it"),
    ]
    got = rows_of(find_leaks(spark.createDataFrame(events, "event_id long, raw string"), spark.createDataFrame(items, "scenario_id long, raw string")))
    assert set(got) == {(1, 1), (2, 2), (3, 3), (6, 4)}
    assert got[1, 1].reparameterised and got[2, 2].reparameterised and got[1, 1].percent == 100 and got[6, 4].covered == 16
