"""A related synthetic dataset of any size.

Every table is a function of its ids, the seed and the reference date. Orders and their
lines draw products by their rank and look up the prices; nothing else is shuffled, as
all other values are hashes on the row itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import below, between, bits, choice, days_before, draw, option
from tidemark.functions.money import MONEY
from tidemark.functions.skew import join_hot_keys, number_within
from tidemark.sources.schemas import schema_of

# Vocabularies, ranges and formats of the generated data.
ORGANIZATIONS = [
    ("Tech Corp", "Technology", "USA"),
    ("Retail Inc", "Retail", "USA"),
    ("Finance Ltd", "Financial Services", "UK"),
    ("Health Plus", "Healthcare", "Canada"),
    ("Food Global", "Food & Beverage", "USA"),
]
PRODUCT_NAMES = {
    "Electronics": ["Laptop", "Smartphone", "Tablet", "Headphones"],
    "Clothing": ["T-Shirt", "Jeans", "Jacket", "Shoes"],
    "Food": ["Coffee", "Tea", "Bread", "Milk"],
    "Books": ["Fiction Novel", "Self-Help", "Science", "Biography"],
    "Home & Garden": ["Pillow", "Blanket", "Lamp", "Plant"],
}
FIRST_NAMES = ["John", "Jane", "Michael", "Sarah", "Robert", "Emma", "David", "Lisa", "James", "Mary"]
LAST_NAMES = [
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez",
]
CITIES = [
    "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Toronto", "London", "Manchester",
    "Vancouver", "Ottawa",
]
STREET_NAMES = [
    "Example Street", "Sample Avenue", "Synthetic Road", "Test Lane", "Demo Boulevard", "Fictional Way",
]
CUSTOMER_SEGMENTS = ["Premium", "Standard", "Basic"]
ORDER_STATUSES = ["Completed", "Pending", "Shipped", "Cancelled"]
COUNTRIES = ["USA", "Canada", "UK"]
EMPLOYEE_DEPARTMENTS = ["Engineering", "Finance", "Operations", "Sales"]
EMPLOYEE_JOB_TITLES = ["Analyst", "Engineer", "Manager", "Specialist"]
EMPLOYEE_TYPES = ["Full-time", "Part-time", "Contractor"]
DEFAULT_CUSTOMERS = 100
DEFAULT_ORDERS = 500
DEFAULT_EMPLOYEES = 100
DEFAULT_SEED = 42
EMPLOYEE_SEED = 84
MAX_ITEMS = 5

CATEGORIES = list(PRODUCT_NAMES)
NAMES_PER_CATEGORY = 4
PRODUCT_SLOTS = len(CATEGORIES) * NAMES_PER_CATEGORY


def ids(spark: SparkSession, count: int) -> DataFrame:
    """The ids 1 to ``count``."""
    return spark.range(1, count + 1)


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Cast and order the columns as the declared schema has them, comments included."""
    return frame.select(
        *[
            F.col(field.name).cast(field.dataType).alias(field.name, metadata=field.metadata)
            for field in schema_of(table).fields
        ]
    )


def organizations(org_ids: DataFrame) -> DataFrame:
    """The five base organizations; further ids repeat them with the id in the name."""
    names, industries, countries = zip(*ORGANIZATIONS)
    template = f"((id - 1) % {len(ORGANIZATIONS)})"
    name = option(template, names)
    return conform(
        org_ids.selectExpr(
            "id AS org_id",
            f"IF(id <= {len(ORGANIZATIONS)}, {name}, concat_ws(' ', {name}, id)) AS org_name",
            f"{option(template, industries)} AS industry",
            f"{option(template, countries)} AS country",
        ),
        "organizations",
    )


# Which products an organization sells follows from a draw on its id: 2 to 4 categories,
# visited from a start with a step that is prime to the number of categories. A draw on
# organization and category gives its 1 to 3 names in the same way. Each draw is split
# into small numbers, so one is enough for each organization and category.


def _org_draw(seed: int, org: str) -> str:
    return draw(seed, "categories", org)


def _category_count(org_draw: str) -> str:
    return f"(shiftright({bits(org_draw, 0, 10)} * 3L, 10) + 2L)"


def _category(org_draw: str, turn: str) -> str:
    start = f"shiftright({bits(org_draw, 10, 10)} * {len(CATEGORIES)}L, 10)"
    step = f"({bits(org_draw, 20, 2)} + 1L)"
    return f"(({start} + {turn} * {step}) % {len(CATEGORIES)}L)"


def _category_draw(seed: int, org: str, category: str) -> str:
    return draw(seed, "names", org, category)


def _name_count(category_draw: str) -> str:
    return f"(shiftright({bits(category_draw, 0, 10)} * 3L, 10) + 1L)"


def _name(category_draw: str, turn: str) -> str:
    step = f"({bits(category_draw, 12, 1)} * 2L + 1L)"
    return f"(({bits(category_draw, 10, 2)} + {turn} * {step}) & {NAMES_PER_CATEGORY - 1}L)"


def _product_id(org: str, category: str, name: str) -> str:
    return f"(({org} - 1L) * {PRODUCT_SLOTS}L + {category} * {NAMES_PER_CATEGORY}L + {name} + 1L)"


def _price_cents(seed: int, product: str) -> str:
    return between(draw(seed, "price", product), 1000, 50000)


def products(organization_rows: DataFrame, as_of_date: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """2 to 4 categories per organization with 1 to 3 distinct names each."""
    offers = (
        organization_rows.selectExpr("org_id", f"{_org_draw(seed, 'org_id')} AS org_draw")
        .selectExpr("org_id", "org_draw", f"explode(sequence(0L, {_category_count('org_draw')} - 1L)) AS turn")
        .selectExpr("org_id", f"{_category('org_draw', 'turn')} AS category_no")
        .selectExpr("*", f"{_category_draw(seed, 'org_id', 'category_no')} AS category_draw")
        .selectExpr("*", f"explode(sequence(0L, {_name_count('category_draw')} - 1L)) AS turn")
        .selectExpr("*", f"{_name('category_draw', 'turn')} AS name_no")
        .selectExpr("*", f"{_product_id('org_id', 'category_no', 'name_no')} AS product_id")
    )
    all_names = [name for category in CATEGORIES for name in PRODUCT_NAMES[category]]
    return conform(
        offers.selectExpr(
            "product_id",
            "org_id",
            f"{option(f'(category_no * {NAMES_PER_CATEGORY} + name_no)', all_names)} AS product_name",
            f"{option('category_no', CATEGORIES)} AS category",
            f"{_price_cents(seed, 'product_id')} / 100.0D AS price",
            f"{between(draw(seed, 'stock', 'product_id'), 10, 1000)} AS stock_quantity",
            f"{days_before(as_of_date, draw(seed, 'created', 'product_id'), 1, 365)} AS created_date",
        ),
        "products",
    )


def customers(customer_ids: DataFrame, as_of_date: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Customers whose personal data is made up and marked as such."""

    def random(stream: str) -> str:
        return draw(seed, stream, "id")

    phone = f"{random('phone')} % 8000000000L + 2000000000L"
    return conform(
        customer_ids.selectExpr(
            "id AS customer_id",
            f"{choice(random('first'), FIRST_NAMES)} AS first_name",
            f"{choice(random('last'), LAST_NAMES)} AS last_name",
            "format_string('customer_%d@example.com', id) AS email",
            f"format_string('+1%d', {phone}) AS phone",
            f"{days_before(as_of_date, random('birth'), 18 * 365, 80 * 365)} AS date_of_birth",
            f"concat_ws(' ', id + 100, {choice(random('street'), STREET_NAMES)}) AS address_line1",
            "format_string('FAKE-%04d', id) AS postal_code",
            "format_string('FAKE-NID-%06d', id) AS national_id",
            f"{choice(random('city'), CITIES)} AS city",
            f"{choice(random('country'), COUNTRIES)} AS country",
            f"{days_before(as_of_date, random('signup'), 1, 730)} AS signup_date",
            f"{choice(random('segment'), CUSTOMER_SEGMENTS)} AS customer_segment",
        ),
        "customers",
    )


def distinct_picks(rows: DataFrame, seed: int, stream: str, key: str, wanted: str, total: str, most: int) -> DataFrame:
    """``rows`` with ``picks``: ``wanted`` different numbers out of 0..total-1, every choice of them as likely.

    The columns ``wanted`` (at most ``total`` and ``most``) and ``total`` are numbers. Floyd's way
    takes one draw for each pick and no list of what there is to pick from: the draw for a pick
    may be any of the first so many numbers, and if it has come before, the last of these is
    taken, which cannot have come.
    """
    columns = rows.columns
    last = [f"({total} - {wanted} + {i}L)" for i in range(most)]
    numbers = [
        f"IF({i} < {wanted}, {below(draw(seed, stream, key, str(i)), f'({last[i]} + 1L)')}, NULL) AS _number_{i}"
        for i in range(most)
    ]
    rows = rows.selectExpr(*columns, *numbers)
    for i in range(most):
        earlier = ", ".join(f"_pick_{j}" for j in range(i))
        pick = f"IF(_number_{i} IN ({earlier}), {last[i]}, _number_{i})" if i else "_number_0"
        rows = rows.selectExpr("*", f"{pick} AS _pick_{i}")
    return rows.selectExpr(*columns, f"array_compact(array({', '.join(f'_pick_{i}' for i in range(most))})) AS picks")


def orders(
    order_ids: DataFrame,
    product_rows: DataFrame,
    customer_total: int,
    organization_total: int,
    as_of_date: str,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Orders of customers 1..customer_total with organizations 1..organization_total.

    An order's amount is the price of ``num_items`` different ones of all products, or of all of
    them if there are fewer. The lines of the order are drawn separately, from its
    organization's products, so they need not add up to the amount.
    """
    count = between(draw(seed, "item count", "order_id"), 1, MAX_ITEMS)
    total = product_rows.select(F.count(F.lit(1))).scalar()
    wanted = order_ids.select(F.col("id").alias("order_id"), total.alias("total"))
    wanted = wanted.selectExpr("order_id", "total", f"least({count}, total) AS wanted")
    picked = distinct_picks(wanted, seed, "product of order", "order_id", "wanted", "total", MAX_ITEMS)
    cents = (F.col("price").cast(MONEY) * 100).cast("long").alias("cents")
    numbered = number_within(product_rows.select(F.lit(0).alias("all"), "product_id", cents), "all", "product_id", "pick")
    amounts = (
        picked.select("order_id", F.explode_outer("picks").alias("pick"))
        .join(numbered.select("pick", "cents"), "pick", "left")
        .groupBy("order_id")
        .agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    )
    return conform(
        amounts.selectExpr(
            "order_id",
            f"{below(draw(seed, 'customer of order', 'order_id'), customer_total)} + 1L AS customer_id",
            f"{below(draw(seed, 'organization of order', 'order_id'), organization_total)} + 1L AS org_id",
            f"{days_before(as_of_date, draw(seed, 'order date', 'order_id'), 1, 365)} AS order_date",
            "cents / 100.0D AS total_amount",
            f"{count} AS num_items",
            f"{choice(draw(seed, 'status', 'order_id'), ORDER_STATUSES)} AS order_status",
        ),
        "orders",
    )


def order_items(
    order_rows: DataFrame, product_rows: DataFrame, seed: int = DEFAULT_SEED, max_items: int = MAX_ITEMS
) -> DataFrame:
    """Lines with different products of the order's organization, every choice of them as likely.

    An order gets ``num_items`` lines, or as many as its organization has products. Works for
    any orders and products; ``max_items`` must be at least the largest ``num_items``.
    """
    sizes = product_rows.groupBy("org_id").agg(F.count(F.lit(1)).alias("available"))
    numbered = number_within(product_rows.select("org_id", "product_id", "price"), "org_id", "product_id", "position")
    too_many = f"raise_error('an order has more than max_items={max_items} items')"
    offered = join_hot_keys(order_rows.select("order_id", "org_id", "num_items"), sizes, "org_id", "order_id").selectExpr(
        "order_id",
        "org_id",
        "available",
        f"IF(num_items > {max_items}, CAST({too_many} AS BIGINT), least(num_items, available)) AS wanted",
    )
    picked = distinct_picks(offered, seed, "product of line", "order_id", "wanted", "available", max_items)
    lines = picked.select("order_id", "org_id", F.posexplode("picks").alias("line", "position")).selectExpr(
        "order_id",
        "org_id",
        "CAST(line AS BIGINT) AS line",
        "position",
        f"{between(draw(seed, 'quantity', 'order_id', 'line'), 1, 5)} AS quantity",
    )
    return conform(
        lines.join(numbered, ["org_id", "position"]).selectExpr(
            f"(order_id - 1L) * {max_items} + line + 1L AS order_item_id",
            "order_id",
            "product_id",
            "quantity",
            "price AS unit_price",
            f"CAST(CAST(price AS {MONEY}) * quantity AS DOUBLE) AS subtotal",
        ),
        "order_items",
    )


def employees(employee_ids: DataFrame, as_of_date: str, seed: int = EMPLOYEE_SEED) -> DataFrame:
    def random(stream: str) -> str:
        return draw(seed, stream, "id")

    return conform(
        employee_ids.selectExpr(
            "id AS employee_id",
            f"{choice(random('first'), FIRST_NAMES)} AS first_name",
            f"{choice(random('last'), LAST_NAMES)} AS last_name",
            "format_string('employee_%d@example.com', id) AS email",
            "format_string('+1-FAKE-%07d', id) AS phone",
            f"{choice(random('department'), EMPLOYEE_DEPARTMENTS)} AS department",
            f"{choice(random('title'), EMPLOYEE_JOB_TITLES)} AS job_title",
            f"{choice(random('country'), COUNTRIES)} AS country",
            f"{choice(random('type'), EMPLOYEE_TYPES)} AS employment_type",
            f"{days_before(as_of_date, random('hired'), 30, 3650)} AS hire_date",
        ),
        "employee_directory_poc",
    )


def dataset(
    spark: SparkSession,
    as_of_date: str,
    organization_count: int = len(ORGANIZATIONS),
    customer_count: int = DEFAULT_CUSTOMERS,
    order_count: int = DEFAULT_ORDERS,
    seed: int = DEFAULT_SEED,
) -> dict[str, DataFrame]:
    """The five related tables."""
    org_rows = organizations(ids(spark, organization_count))
    product_rows = products(org_rows, as_of_date, seed)
    order_rows = orders(ids(spark, order_count), product_rows, customer_count, organization_count, as_of_date, seed)
    return {
        "organizations": org_rows,
        "products": product_rows,
        "customers": customers(ids(spark, customer_count), as_of_date, seed),
        "orders": order_rows,
        "order_items": order_items(order_rows, product_rows, seed),
    }
