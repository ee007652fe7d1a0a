"""Command line: python -m palimpsest PATH head | status | verify | get COLL ID | scan AFTER [LIMIT] | query TEXT | export FOLDER | repair FOLDER."""

import json
import sys

from pyspark.sql import SparkSession

from palimpsest.database import Database
from palimpsest.streaming import feed


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    path, command, *rest = args
    db = Database(spark or SparkSession.builder.appName("palimpsest").getOrCreate(), path)
    say = lambda x: print(json.dumps(x, default=str))
    if command == "head":
        say({"head": db.head, "seq": db.seq})
    elif command == "status":
        say(feed.scan_status(db.ops()).first().asDict() | {"collections": {r.coll: r.n for r in db.collections().collect()}})
    elif command == "verify":
        bad = db.verify().where("not ok")
        n = bad.count()
        say({"ok": n == 0, "bad": n, "first": [r.seq for r in bad.orderBy("seq").limit(20).collect()]})
        return int(n > 0)
    elif command == "get":
        say(db.get(*rest[:2]))
    elif command == "scan":
        for r in feed.since(db.ops(), *map(int, rest)).toLocalIterator():
            say(r.asDict())
    elif command == "query":
        for r in db.query(rest[0]).toLocalIterator():
            say(r.asDict(recursive=True))
    elif command == "export":
        db.export(rest[0])
    elif command == "repair":
        say({"head": db.heal(rest[0]).head})
    else:
        print(__doc__, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
