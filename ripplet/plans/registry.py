"""A small registry: a module's queries and their SQL."""


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put
