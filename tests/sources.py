"""Source files for the tests: a small order system in four languages."""

PYTHON = '''"""Ledger of a small shop."""
from dataclasses import dataclass
import json

LIMIT = 10


@dataclass
class Entry:
    """One line."""

    key: str
    amount: int = 0


class Ledger(BaseLedger):
    def add(self, entry, *, force=False):
        self.check(entry)
        self._store.add(entry)
        return Helper.clean(entry)

    async def check(self, entry):
        def inner():
            return deep(entry)

        return inner()


class Helper:
    @staticmethod
    def clean(entry):
        return json.dumps(entry)


def main():
    Ledger().add(Entry("a"))


main()
'''
BROKEN = "def broken(:\n    pass\n"
JAVA_STORE = """package shop.store;

import java.util.Map;
import java.util.HashMap;

/** Keeps
 *  items. */
public class Store extends BaseStore implements Closeable, Iterable<Item> {
    private final Map<String, Item> items = new HashMap<>();
    int a = 1, b;

    public Store(int size) {
        reset(size);
    }

    public Item find(String key) {
        return items.get(key);
    }

    public Item find(String key, Item other) {
        Item found = find(key);
        if (found == null) {
            return other.copy();
        }
        return found;
    }

    private void reset(int size) { }

    enum Kind { SMALL, LARGE; int rank() { return 0; } }
}
"""
JAVA_DESK = """package shop;

import shop.store.Store;

interface Greeter {
    String greet(String name);
}

public class Desk {
    private Store store;

    void serve(Client client) {
        Store spare = new Store(3);
        store.find("x");
        spare.find("y", null);
        client.find("z");
        Math.max(1, 2);
        this.serve(client);
        System.out.println("done");
    }
}
"""
C_HEADER = """#ifndef POOL_H
#define POOL_H

#include <stddef.h>
#include "item.h"

#define POOL_MAX 8
#define POOL_SIZE(n) ((n) * \\
    POOL_MAX)

/* Takes one. */
int pool_take(struct pool *p, int n);
int pool_count(void);
void pool_log(const char *fmt, ...);

struct pool {
    char name[32];
    int *slots, used;
};

typedef struct pool pool_t;
enum color { RED, GREEN = 2 };
#endif
"""
C_SOURCE = """#include "pool.h"

static int total = 0, *spare;

int pool_count(void) {
    return total;
}

int pool_take(struct pool *p, int n) {
    p->hook(n);
    return pool_count() + helper(n, sizeof(int));
}
"""
JSX = """import React, { useState } from "react";
import Row from "./Row";

const API_URL = "/api";

// Loads rows.
export async function loadRows(page) {
  const answer = await fetch(`${API_URL}/rows?p=${encode(page)}`);
  return answer.json();
}

export function useRows() {
  const [rows, setRows] = useState([]);
  const reload = useCallback(async () => {
    setRows(await loadRows(1));
  }, []);
  return { rows, reload };
}

export default class Table extends React.Component {
  render() {
    const { rows } = this.props;
    return (
      <table onClick={() => this.sort("don't")}>
        {rows.map((row) => <Row key={row.id} {...row} />)}
        it's text / not code
      </table>
    );
  }

  sort(by) {
    return by.replace(/[/"]/g, "");
  }
}
"""
FILES = [
    ("py", "py/ledger.py", PYTHON), ("py", "py/broken.py", BROKEN), ("java", "java/store/Store.java", JAVA_STORE), ("java", "java/Desk.java", JAVA_DESK),
    ("c", "c/pool.h", C_HEADER), ("c", "c/pool.c", C_SOURCE), ("js", "js/Table.jsx", JSX), ("js", "js/Row.js", "export default () => <tr/>;\n"), ("js", "js/notes.txt", "not source"),
]
