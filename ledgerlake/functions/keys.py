"""Key codecs as Column expressions: composite keys of the order-entry schema packed into one bigint, and back.

Warehouses and districts start at 1; a warehouse has districts 1 to 10, so district keys end in 0 for district 10.
Stock and line keys leave ITEMS and ORDERS numbers to a warehouse and district: numbers beyond run into the next one's,
so that a key alone no longer tells them. Decoders that are given the warehouse or district read any number.
Quotients are of whole numbers: as doubles they would be off for keys from 2**53 on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTRICTS, CUSTOMERS, ITEMS, MOST_LINES, ORDERS = 10, 3_000, 100_000, 15, 10_000_000
_WORD = 1 << 32


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _over(x: Column, by: int) -> Column:
    """The quotient rounded down, by whole numbers only."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by)).cast("long")


def district_key(w: Column, d: Column) -> Column:
    return _long(w) * DISTRICTS + _long(d)


def district_key_to_warehouse(k: Column) -> Column:
    return _over(_long(k) - 1, DISTRICTS)


def district_key_to_district(k: Column) -> Column:
    return (k - 1) % DISTRICTS + 1


def _under_district(w: Column, d: Column, low: Column) -> Column:
    return F.shiftleft(district_key(w, d), 32).bitwiseOR(_long(low))


def customer_key(w: Column, d: Column, c: Column) -> Column:
    return _under_district(w, d, c)


def order_key(w: Column, d: Column, o: Column) -> Column:
    return _under_district(w, d, o)


new_order_key = order_key


def upper_to_district_key(k: Column) -> Column:
    """The district part of a customer, order or new-order key."""
    return F.shiftright(k, 32)


def lower_part(k: Column) -> Column:
    """The customer or order number of such a key."""
    return k.bitwiseAND(F.lit(_WORD - 1))


def order_index_key(w: Column, d: Column, c: Column, o: Column) -> Column:
    """Orders of a customer lie together, in order of their numbers."""
    return F.shiftleft(district_key(w, d) * CUSTOMERS + _long(c), 32).bitwiseOR(_long(o))


def customer_key_to_customer(k: Column) -> Column:
    """The customer's number in a customer key."""
    return lower_part(k)


def order_index_key_to_customer_key(k: Column) -> Column:
    """The customer key of an order-index key."""
    return _numbered_to_customer_key(F.shiftright(k, 32))


def _numbered_to_customer_key(numbered: Column) -> Column:
    """A customer numbered over all districts, as a customer key."""
    return F.shiftleft(_over(_long(numbered) - 1, CUSTOMERS), 32).bitwiseOR((numbered - 1) % CUSTOMERS + 1)


def history_key_to_customer_key(k: Column) -> Column:
    """The customer key of a history key."""
    return _numbered_to_customer_key(F.shiftright(k, 20))


def history_key_to_district_key(k: Column) -> Column:
    """The key of the district in which a history row was paid."""
    return k.bitwiseAND(F.lit((1 << 20) - 1))


def history_key(cw: Column, cd: Column, c: Column, d: Column, w: Column) -> Column:
    return F.shiftleft(district_key(cw, cd) * CUSTOMERS + _long(c), 20).bitwiseOR(district_key(w, d))


def order_line_key(w: Column, d: Column, o: Column, number: Column) -> Column:
    return (district_key(w, d) * ORDERS + _long(o)) * MOST_LINES + _long(number)


def order_line_key_to_number(k: Column) -> Column:
    return (k - 1) % MOST_LINES + 1


def order_line_key_to_order_key(k: Column, district: Column | None = None) -> Column:
    """The order key of a line key; order numbers from ORDERS on need the key of their district."""
    upper = _over(_long(k) - 1, MOST_LINES)
    district = _over(upper, ORDERS) if district is None else _long(district)
    return F.shiftleft(district, 32).bitwiseOR(upper - district * ORDERS)


def stock_key(w: Column, i: Column) -> Column:
    return _long(i) + _long(w) * ITEMS


def stock_key_to_warehouse(k: Column) -> Column:
    return _over(_long(k) - 1, ITEMS)


def stock_key_to_item(k: Column, w: Column | None = None) -> Column:
    """The item of a stock key; items over ITEMS need their warehouse."""
    return (k - 1) % ITEMS + 1 if w is None else _long(k) - _long(w) * ITEMS


def supplier_of_stock(w: Column, i: Column, suppliers: int = 10_000) -> Column:
    """The supplier that a stock row belongs to, which no column stores."""
    return _long(w) * _long(i) % suppliers + 1


def nation_of_state(state: Column) -> Column:
    """Nation keys are the codes of a state's first character."""
    return F.ascii(F.substring(state, 1, 1))
