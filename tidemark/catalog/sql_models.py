"""SQL of the model queries' oracles: standardization, ridge and Newton steps as generated text, systems solved by Gaussian elimination column by column."""
from tidemark.catalog.oracle_views import VIEWS

def standardized(name, source, features):
    """View `name`: the rows of `source` with z_<feature> by the training mean and population deviation of (target, version, fold)."""
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    z = ", ".join(f"CASE WHEN s_{f} > 1e-12 * greatest(1, abs(m_{f})) THEN ({f} - m_{f}) / s_{f} ELSE 0 END AS z_{f}" for f in features)
    VIEWS[name] = ((source,), f"SELECT d.*, {z} FROM {source} d JOIN (SELECT target, version, fold, {stats} FROM {source} WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3) m USING (target, version, fold)")


def eliminated(k):
    """Select items that turn the columns a<i>_<j> (i <= j, symmetric) and c<i> into x0 .. x<k-1>, each item using those before it."""
    items, a, c = [], {(i, j): f"a{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)}, {i: f"c{i}" for i in range(k)}
    for p in range(k):
        for i in range(p + 1, k):
            items.append(f"{a[i, p]} / {a[p, p]} AS f{p}_{i}")
            for j in range(p + 1, k):
                items.append(f"{a[i, j]} - f{p}_{i} * {a[p, j]} AS e{p}_{i}_{j}")
            items.append(f"{c[i]} - f{p}_{i} * {c[p]} AS d{p}_{i}")
        for i in range(p + 1, k):
            for j in range(p + 1, k):
                a[i, j] = f"e{p}_{i}_{j}"
            c[i] = f"d{p}_{i}"
    for i in reversed(range(k)):
        rest = "".join(f" - {a[i, j]} * x{j}" for j in range(i + 1, k))
        items.append(f"({c[i]}{rest}) / {a[i, i]} AS x{i}")
    return ", ".join(items)


def linear(features, beta="b"):
    return " + ".join([f"{beta}0"] + [f"{beta}{i + 1} * z_{f}" for i, f in enumerate(features)])


def sigmoid(z):
    return f"CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END"


def ridge(name, source, features, minimum=40):
    """View `name`: target, fold, n, state, b0.. of a ridge fit with penalty one, the intercept free."""
    x = ["1.0"] + [f"z_{f}" for f in features]
    k = len(x)
    sums = [f"sum({x[i]} * {x[j]}) + {1.0 if i == j and i else 0.0} AS a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum({x[i]} * y) AS c{i}" for i in range(k)]
    betas = ", ".join(f"CASE WHEN n >= {minimum} THEN x{i} END AS b{i}" for i in range(k))
    VIEWS[name] = ((source,), f"""SELECT target, version, fold, n, CASE WHEN n >= {minimum} THEN 'FITTED' ELSE 'INSUFFICIENT_DATA' END AS state, {betas} FROM (SELECT target, version, fold, n, {eliminated(k)}
 FROM (SELECT target, version, fold, count(*) AS n, {', '.join(sums)} FROM {source} WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3))""")


def logistic(name, source, features, minimum=10, rounds=12):
    """View `name`: target, fold, n, state, iterations, b0.. of a ridge-penalized logistic fit by Newton steps; the step that moves less than 1e-8 is the last."""
    x = ["1.0"] + [f"z_{f}" for f in features]
    k = len(x)
    zero = ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(k))
    VIEWS[f"{name}_0"] = ((source,), f"SELECT target, version, fold, count(*) AS n, least(sum(y), count(*) - sum(y)) >= {minimum} AS enough, NULL::INTEGER AS iterations, {zero} FROM {source} WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2, 3")
    for t in range(1, rounds + 1):
        last = f"{name}_{t - 1}"
        sums = [f"sum({x[i]} * {x[j]} * p * (1 - p)) + {1.0 if i == j and i else 0.0} AS a{i}_{j}" for i in range(k) for j in range(i, k)]
        sums += [f"sum({x[i]} * (y - p)) - {1.0 if i else 0.0} * any_value(b{i}) AS c{i}" for i in range(k)]
        carried = ", ".join(["any_value(n) AS n", "any_value(enough) AS enough", "any_value(iterations) AS iterations"] + [f"any_value(b{i}) AS b{i}" for i in range(k)])
        moved = "greatest(" + ", ".join(f"abs(x{i})" for i in range(k)) + ")"
        step = ", ".join(f"CASE WHEN iterations IS NULL THEN b{i} + x{i} ELSE b{i} END AS b{i}" for i in range(k))
        VIEWS[f"{name}_{t}"] = ((source, last), f"""SELECT target, version, fold, n, enough, coalesce(iterations, CASE WHEN {moved} < 1e-8 THEN {t} END) AS iterations, {step} FROM (SELECT *, {eliminated(k)} FROM (
 SELECT target, version, fold, {carried}, {', '.join(sums)} FROM (SELECT d.*, m.*  EXCLUDE (target, version, fold), {sigmoid(linear(features, 'm.b'))} AS p FROM {source} d JOIN {last} m USING (target, version, fold) WHERE d.role = 'train' AND d.y IS NOT NULL) GROUP BY 1, 2, 3))""")
    betas = ", ".join(f"CASE WHEN enough AND iterations IS NOT NULL THEN b{i} END AS b{i}" for i in range(k))
    VIEWS[name] = ((f"{name}_{rounds}",), f"SELECT target, version, fold, n, CASE WHEN NOT enough THEN 'INSUFFICIENT_DATA' WHEN iterations IS NULL THEN 'MODEL_FIT_FAILED' ELSE 'FITTED' END AS state, CASE WHEN enough THEN iterations ELSE 0 END AS iterations, {betas} FROM {name}_{rounds}")


def betas(k, digits=6):
    return ", ".join(f"round(b{i}, {digits}) + 0.0 AS b{i}" for i in range(k))
