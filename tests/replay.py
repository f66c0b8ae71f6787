"""Event by event: what identity and profiles must be after each one."""

from meridia.operators.profiles import LAST, _TEXTS


class Clusters:
    """Clusters of one component while its events are replayed: memory grows with its identifiers, not its events."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.owner: dict[str, str] = {}
        self.age: dict[str, int] = {}

    def root(self, cluster: str) -> str:
        while self.parent[cluster] != cluster:
            self.parent[cluster] = cluster = self.parent[self.parent[cluster]]
        return cluster

    def take(self, event: str, nodes: list[str]) -> tuple[str, list[str]]:
        """(surviving cluster, clusters merged into it) when an event with these nodes arrives."""
        found = sorted({self.root(self.owner[n]) for n in nodes if n in self.owner}, key=self.age.__getitem__)
        if not found:
            made = f"c_{event}"
            self.parent[made], self.age[made] = made, len(self.age)
            found = [made]
        survivor, losers = found[0], found[1:]
        for loser in losers:
            self.parent[loser] = survivor
        for n in nodes:
            self.owner[n] = survivor
        return survivor, losers


class Profile:
    """One profile during a replay."""

    def __init__(self) -> None:
        self.values = {}
        self.events = self.orders = self.version = 0
        self.last_order = self.first = self.last = None

    def apply(self, r) -> None:
        for c in _TEXTS:
            if v := getattr(r, c):
                self.values[c] = v
        self.events += 1
        if r.is_order:
            self.orders += 1
            self.last_order = r.timestamp
        self.first = r.timestamp if self.first is None else min(self.first, r.timestamp)
        self.last = r.timestamp if self.last is None else max(self.last, r.timestamp)
        self.version += 1

    def absorb(self, other) -> None:
        """Take over a profile whose cluster merged into this one."""
        newer = other.last is not None and (self.last is None or other.last > self.last)
        for c, v in other.values.items():
            if c not in self.values or (newer and c in LAST):
                self.values[c] = v
        self.events += other.events
        self.orders += other.orders
        orders = [t for t in (self.last_order, other.last_order) if t is not None]
        self.last_order = max(orders, default=None)
        self.first = min((t for t in (self.first, other.first) if t is not None), default=None)
        self.last = max((t for t in (self.last, other.last) if t is not None), default=None)

    def row(self, tenant: str, cluster: str) -> tuple:
        texts = (self.values.get(c) for c in _TEXTS)
        return (tenant, cluster, *texts, self.events, self.orders, self.last_order, self.first, self.last, self.version)


def replayed(rows):
    """Rows (tenant_id, event_id, nodes and observed columns) in arrival order: (profile rows, merges, clusters of events)."""
    states, live, merges, homes = {}, {}, set(), {}
    for r in rows:
        if not r.nodes:
            continue
        state, mine = states.setdefault(r.tenant_id, Clusters()), live.setdefault(r.tenant_id, {})
        survivor, losers = state.take(r.event_id, sorted(r.nodes))
        homes[r.tenant_id, r.event_id] = survivor, tuple("customer_" + x[2:] for x in losers)
        merges |= {(r.tenant_id, x, survivor, r.event_id) for x in losers}
        profile = mine.setdefault(survivor, Profile())
        for x in losers:
            profile.absorb(mine.pop(x))
        profile.apply(r)
    return {p.row(t, c) for t, mine in live.items() for c, p in mine.items()}, merges, homes
