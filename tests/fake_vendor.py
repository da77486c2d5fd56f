"""A vendor with a tick at every whole number; its position is what stands in a file, or 6."""

import os


class Feed:
    def authenticate(self, options):
        self.key = options["key"]
        self.log = options.get("log")

    def connect(self):
        assert self.key == "secret"

    def subscribe(self, symbols):
        self.symbols = symbols

    @staticmethod
    def position(options):
        return int(open(options["position"]).read()) if "position" in options else 6

    def fetch_historical(self, symbol, first_ns, last_ns):
        return [(symbol, t, float(t), 1) for t in range(first_ns, last_ns + 1)]

    def fetch_live(self, symbol, after, until):
        assert self.symbols == [symbol]
        if self.log:
            with open(self.log, "a") as file:
                file.write(f"{symbol} {after} {until} {os.getpid()}\n")
        return [(symbol, t, float(t), 1) for t in range(after, until)]
