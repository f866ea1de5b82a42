from hostwin.llm.common import sole


def test_one_large_thing_at_a_time():
    made, alive = [], set()

    class Thing:
        def __init__(self, name):
            made.append((name, len(alive)))
            alive.add(name)
            self.name = name

        def __del__(self):
            alive.discard(self.name)

    @sole
    def first(x):
        return Thing(f"first {x}")

    @sole
    def second(x):
        return Thing(f"second {x}")

    assert first(1) is first(1)
    for make, x in ((second, 1), (first, 1), (first, 2)):
        make(x)
    # Each is made once while it is the last, and the one before is gone by then.
    assert made == [("first 1", 0), ("second 1", 0), ("first 1", 0), ("first 2", 0)]
