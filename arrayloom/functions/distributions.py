"""Distributions and their algebra. A distribution is a tree of parameters; sampling it is a column over a row id.

Each leaf draws by its own seed, made from the seed given and the leaf's place in the tree, so that operands of a sum
are independent and a tree gives the same numbers for the same seed.
"""

from __future__ import annotations

import json
import math
import statistics
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrayloom.functions import elementwise as E  # noqa: N812
from arrayloom.functions.random import ensure_seed, hash_uniform, session_seed, standard_normal


class CoerceError(ValueError):
    """What was given is no distribution."""


@dataclass
class Value:
    """What a parameter may be: a default, a range, tests, and help."""

    default: object = None
    min: float | None = None
    max: float | None = None
    help: str = ""
    constraints: list[Callable] = field(default_factory=list)
    type: type = float
    name: str = ""

    def sample(self, seed: int = 0) -> float:
        """A value in the range, by default within 1024 of 0."""
        low, high = -1024 if self.min is None else self.min, 1024 if self.max is None else self.max
        u = ensure_seed(f"{seed}:{self.name}") / (2**32 - 1)
        x = low + u * (high - low)
        if self.type not in (int, float):
            raise NotImplementedError(self.type)
        return int(x) if self.type is int else x

    def check(self, x) -> None:
        number = isinstance(x, (int, float)) and not isinstance(x, bool)
        if number and (self.min is not None and x < self.min or self.max is not None and x > self.max) or not all(test(x) for test in self.constraints):
            raise ValueError(f"{self.name} can't be {x!r}")


class Parameterized:
    """A node of a tree: named parameters, and children that are nodes too."""

    def __init__(self, **params) -> None:
        self.params = {k: v for k, v in params.items() if not isinstance(v, Parameterized)}
        self.kids = {k: v for k, v in params.items() if isinstance(v, Parameterized)}

    def children(self) -> Iterator[tuple[str, Parameterized]]:
        yield from self.kids.items()

    def parameters(self) -> Iterator[tuple[str, object]]:
        yield from self.params.items()
        for name, child in self.children():
            for key, value in child.parameters():
                yield f"{name}.{key}", value

    def idstr(self) -> str:
        parts = [f"{k}={v!r}" for k, v in self.params.items()] + [f"{k}={c.idstr()}" for k, c in self.children()]
        return f"{type(self).__name__}({', '.join(parts)})"

    def json_id(self) -> dict:
        plain = {k: v if isinstance(v, (int, float, str, bool, list, tuple, type(None))) else getattr(v, "__name__", str(v)) for k, v in self.params.items()}
        return {"__class__": type(self).__name__} | plain | {k: c.json_id() for k, c in self.children()}

    def json(self) -> str:
        return json.dumps(self.json_id())


class ParameterizedList(Parameterized):
    """A list of nodes, as children named by number."""

    def __init__(self, items: list) -> None:
        super().__init__(**{str(i): x for i, x in enumerate(items)})


def _operand(x) -> Distribution:
    return x if isinstance(x, Distribution) else Constant(x)


class Distribution(Parameterized):
    """Subclasses have `values`, a dict of Value in the order of arguments, and draw()."""

    values: dict[str, Value] = {}

    def __init__(self, *args, seed: int | str | float | None = None, **kw) -> None:
        names = list(self.values)
        if len(args) > len(names) or set(kw) - set(names):
            raise TypeError(f"{type(self).__name__} takes {names}")
        given = dict(zip(names, args, strict=False)) | kw
        params = {k: given.get(k, v.default) for k, v in self.values.items()}
        for k, v in self.values.items():
            v.name = k
            v.check(params[k])
        super().__init__(**params)
        self.own_seed = seed

    def __getattr__(self, name: str):
        for place in ("params", "kids"):
            if name in self.__dict__.get(place, {}):
                return self.__dict__[place][name]
        raise AttributeError(name)

    def seeded_with(self, seed) -> Distribution:
        self.own_seed = seed
        return self

    def draw(self, row: Column, seed: str) -> Column:
        raise NotImplementedError

    def sample(self, row: Column | str = "id", seed: int | str | float | None = None) -> Column:
        """A draw for each row id."""
        row = F.col(row) if isinstance(row, str) else row
        return self.draw(row, str(ensure_seed(session_seed(self.own_seed if seed is None else seed))))

    __call__ = sample

    def histogram(self, df, row: str = "id", bins: int = 20, seed: int = 0):
        """low, high, n of equal bins over the samples of df's rows."""
        drawn = df.select(self.sample(row, seed).cast("double").alias("x"))
        ends = drawn.agg(F.min("x").alias("a"), F.max("x").alias("b"))
        no = F.least(F.lit(bins - 1), F.floor(E.divide(F.col("x") - F.col("a"), (F.col("b") - F.col("a")) / bins)).cast("int"))
        counted = drawn.join(F.broadcast(ends)).withColumn("bin", F.coalesce(no, F.lit(0)))  # one row
        step = (F.col("b") - F.col("a")) / bins
        return counted.groupBy("bin", "a", "b").agg(F.count("*").alias("n")).select((F.col("a") + F.col("bin") * step).alias("low"), (F.col("a") + (F.col("bin") + 1) * step).alias("high"), "n")

    @classmethod
    def coerce(cls, x, seed=None) -> Distribution:
        """A distribution as it is; a sequence or dict as arguments; scalars where a class has a shortcut."""
        if isinstance(x, Distribution):
            return x
        if isinstance(x, (list, tuple)):
            return cls(*x, seed=seed)
        if isinstance(x, dict):
            return cls(**x, seed=seed)
        return cls._scalar(x, seed)

    cast = coerce

    @classmethod
    def _scalar(cls, x, seed) -> Distribution:
        raise CoerceError(f"{x!r} is no {cls.__name__}")

    @classmethod
    def seeded(cls, seed=0) -> Seeded:
        return Seeded(seed, cls)

    @classmethod
    def random(cls, seed: int = 0) -> Distribution:
        """Random parameters; of Distribution itself also a random family."""
        if cls is Distribution:
            families = [Normal, Exponential, TruncNormal, Uniform]
            return families[ensure_seed(f"{seed}:family") % len(families)].random(seed)
        kw = {}
        for k, v in cls.values.items():
            v.name = k
            kw[k] = v.sample(seed)
        if "low" in kw and "high" in kw and kw["low"] > kw["high"]:
            kw["low"], kw["high"] = kw["high"], kw["low"]
        return cls(**kw, seed=seed)

    def _with(self, name: str, fn: Callable, *others) -> Composed:
        return Composed(fn, [self, *others], name)

    def __add__(self, x): return self._with("add", lambda a, b: a + b, x)  # noqa: E704
    def __radd__(self, x): return Composed(lambda a, b: a + b, [x, self], "add")  # noqa: E704
    def __sub__(self, x): return self._with("sub", lambda a, b: a - b, x)  # noqa: E704
    def __rsub__(self, x): return Composed(lambda a, b: a - b, [x, self], "sub")  # noqa: E704
    def __mul__(self, x): return self._with("mul", lambda a, b: a * b, x)  # noqa: E704
    def __rmul__(self, x): return Composed(lambda a, b: a * b, [x, self], "mul")  # noqa: E704
    def __truediv__(self, x): return self._with("div", E.divide, x)  # noqa: E704
    def __rtruediv__(self, x): return Composed(E.divide, [x, self], "div")  # noqa: E704
    def __pow__(self, x): return self._with("pow", F.pow, x)  # noqa: E704
    def __rpow__(self, x): return Composed(F.pow, [x, self], "pow")  # noqa: E704
    def __neg__(self): return self._with("neg", lambda a: -a)  # noqa: E704
    def __pos__(self): return self._with("pos", lambda a: a)  # noqa: E704
    def __abs__(self): return self._with("abs", F.abs)  # noqa: E704
    def __round__(self, n: int = 0): return self._with("round", lambda a: E.round_even(a, n))  # noqa: E704
    def __trunc__(self): return self._with("trunc", E.trunc)  # noqa: E704
    def __floor__(self): return self._with("floor", E.floor)  # noqa: E704
    def __ceil__(self): return self._with("ceil", E.ceil)  # noqa: E704

    floor, ceil, trunc, round, abs = __floor__, __ceil__, __trunc__, __round__, __abs__

    def int(self): return self._with("int", lambda a: E.trunc(a).cast("bigint"))  # noqa: E704
    def clip(self, low=None, high=None): return self._with("clip", lambda a: E.clip(a, low, high))  # noqa: E704
    def log(self): return self._with("log", E.log)  # noqa: E704
    def log10(self): return self._with("log10", E.log10)  # noqa: E704
    def exp(self): return self._with("exp", F.exp)  # noqa: E704
    def sqrt(self): return self._with("sqrt", F.sqrt)  # noqa: E704


def _no_operator(self, *_):
    raise NotImplementedError


for _name in ("matmul", "floordiv", "mod", "lshift", "rshift", "and", "xor", "or", "invert"):
    setattr(Distribution, f"__{_name}__", _no_operator)


class Composed(Distribution):
    """An operation over operands, each drawn by itself; what is no distribution stands for itself."""

    def __init__(self, operation: Callable, operands: list, name: str | None = None) -> None:
        self.operation = operation
        Parameterized.__init__(self, operation=name or getattr(operation, "__name__", "operation"), operands=ParameterizedList([_operand(x) for x in operands]))
        self.own_seed = None

    def draw(self, row, seed):
        kids = self.kids["operands"].children()
        return self.operation(*[c.draw(row, f"{seed}.{k}") for k, c in kids])


class Mixture(Distribution):
    """One of several distributions, chosen by weight."""

    def __init__(self, pdfs: list[Distribution], weights: list[float] | None = None, seed=None) -> None:
        weights = [1.0] * len(pdfs) if weights is None else list(weights)
        Parameterized.__init__(self, weights=weights, pdfs=ParameterizedList(pdfs))
        self.own_seed = seed

    def draw(self, row, seed):
        drawn = [c.draw(row, f"{seed}.{k}").cast("double") for k, c in self.kids["pdfs"].children()]
        return _chosen(hash_uniform(row, f"{seed}.choice"), drawn, self.params["weights"])


def _chosen(u: Column, options: list[Column], weights: list[float]) -> Column:
    total, below = sum(weights), 0.0
    out = None
    for x, w in list(zip(options, weights, strict=True))[:-1]:
        below += w / total
        out = F.when(u < below, x) if out is None else out.when(u < below, x)
    return options[-1] if out is None else out.otherwise(options[-1])


class Uniform(Distribution):
    """Between low and high; high is the first argument."""

    values = {"high": Value(1.0), "low": Value(0.0)}

    def draw(self, row, seed):
        return F.lit(float(self.low)) + hash_uniform(row, seed) * F.lit(float(self.high) - float(self.low))

    @classmethod
    def _scalar(cls, x, seed):
        return cls(x, seed=seed)


class Exponential(Distribution):
    """Of mean scale."""

    values = {"scale": Value(1.0, min=0)}

    def draw(self, row, seed):
        return F.lit(-float(self.scale)) * F.ln(1 - hash_uniform(row, seed))


class Constant(Distribution):
    values = {"value": Value(1, type=object)}

    def draw(self, row, seed):
        return F.lit(self.value)


class DiscreteUniform(Distribution):
    """Whole numbers from min to below max."""

    values = {"min": Value(0, type=int), "max": Value(1, type=int)}

    def draw(self, row, seed):
        return F.floor(F.lit(self.min) + hash_uniform(row, seed) * F.lit(self.max - self.min)).cast("bigint")

    @classmethod
    def _scalar(cls, x, seed):
        return cls(0, x, seed=seed)


class Normal(Distribution):
    values = {"mean": Value(0.0), "std": Value(1.0, min=0)}

    def draw(self, row, seed):
        return standard_normal(row, self.mean, self.std, seed)


#: The rational approximations of the standard normal quantile in Wichura's algorithm AS 241 (PPND16), each
#: the coefficients of the numerator and of the denominator, constant first.
QUANTILE_CENTRE = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
QUANTILE_SIDE = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9],
)
QUANTILE_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7],
    [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), to about 16 digits."""

    def ratio(tables: tuple[list[float], list[float]], r: Column) -> Column:
        parts = []
        for values in tables:
            out = F.lit(values[-1])
            for v in reversed(values[:-1]):
                out = out * r + F.lit(v)
            parts.append(out)
        return parts[0] / parts[1]

    q = p - F.lit(0.5)
    far = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    side = F.when(far <= 5, ratio(QUANTILE_SIDE, far - F.lit(1.6))).otherwise(ratio(QUANTILE_TAIL, far - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * side)


class TruncNormal(Distribution):
    """Normal within low and high, by the inverse of its distribution function; nothing is clipped."""

    values = {"mean": Value(0.0), "std": Value(1.0, min=1e-12), "low": Value(-math.inf), "high": Value(math.inf)}

    def draw(self, row, seed):
        normal = statistics.NormalDist(self.mean, self.std)
        a = 0.0 if self.low == -math.inf else normal.cdf(self.low)
        b = 1.0 if self.high == math.inf else normal.cdf(self.high)
        p = F.least(F.greatest(F.lit(a) + hash_uniform(row, seed) * F.lit(b - a), F.lit(1e-300)), F.lit(1 - 1e-16))
        return F.least(F.greatest(F.lit(float(self.mean)) + F.lit(float(self.std)) * normal_quantile(p), F.lit(float(self.low))), F.lit(float(self.high)))


class Bernoulli(Distribution):
    values = {"p": Value(0.5, min=0, max=1)}

    def draw(self, row, seed):
        return hash_uniform(row, seed) < F.lit(float(self.p))

    @classmethod
    def _scalar(cls, x, seed):
        return cls(x, seed=seed)


class Binomial(Distribution):
    """How many of n trials succeed; p is the first argument."""

    values = {"p": Value(0.5, min=0, max=1), "n": Value(1, min=0, type=int)}

    def draw(self, row, seed):
        p = float(self.p)
        if not self.n:
            return F.lit(0).cast("bigint")
        trial = lambda i: F.when(hash_uniform(F.concat(row.cast("string"), F.lit("#"), i.cast("string")), seed) < p, 1).otherwise(0)
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(int(self.n))), trial), F.lit(0).cast("bigint"), lambda s, x: s + x)


class Categorical(Distribution):
    values = {"categories": Value(None, type=object), "weights": Value(None, type=object)}

    def draw(self, row, seed):
        options = list(self.categories)
        return _chosen(hash_uniform(row, seed), [F.lit(x) for x in options], list(self.weights) if self.weights is not None else [1.0] * len(options))


class CategoryUniform(Categorical):
    """A choice without weights."""

    values = {"categories": Value(None, type=object)}

    def draw(self, row, seed):
        options = list(self.categories)
        return F.get(F.array(*[F.lit(x) for x in options]), F.floor(hash_uniform(row, seed) * len(options)).cast("int"))


class NonlinearUniform(Distribution):
    """Uniform numbers bent by a function of 0 to 1: exp, log, squared, sqrt, a power (a float), or any of columns."""

    values = {"min": Value(0.0), "max": Value(1.0), "nonlinearity": Value(None, type=object), "reverse": Value(False, type=bool)}
    _named = {"linear": lambda u: u, "exp": lambda u: (F.exp(u) - 1) / F.lit(math.e - 1), "log": lambda u: F.ln(u + 1) / F.lit(math.log(2)), "squared": lambda u: u * u, "sqrt": F.sqrt}

    def draw(self, row, seed):
        bend = self.nonlinearity
        if bend is None or isinstance(bend, str):
            bend = self._named[bend or "linear"]
        elif isinstance(bend, float):
            power = bend
            bend = lambda u: F.pow(u, F.lit(power))
        elif not callable(bend):
            raise KeyError(bend)
        u = hash_uniform(row, seed)
        return bend(1 - u if self.reverse else u) * F.lit(float(self.max) - float(self.min)) + F.lit(float(self.min))


class PDF(Distribution):
    """A density given at points (or over a range) as weights of bins: piecewise linear inverse distribution."""

    values = {"x": Value(None, type=object), "p": Value(None, type=object)}

    def edges(self) -> tuple[list[float], list[float]]:
        x, p = list(self.x), [float(v) for v in self.p]
        n = len(p)
        if isinstance(self.x, tuple):
            edge = [x[0] + (x[1] - x[0]) * i / n for i in range(n + 1)]
        else:
            at = [i * (len(x) - 1) / n for i in range(n + 1)]
            edge = [x[int(t)] + (x[min(int(t) + 1, len(x) - 1)] - x[int(t)]) * (t - int(t)) for t in at]
        total, below = sum(p), [0.0]
        for v in p:
            below.append(below[-1] + v / total)
        return edge, below

    def draw(self, row, seed):
        edge, below = self.edges()
        u = hash_uniform(row, seed)
        out = F.lit(float(edge[-1]))
        for i in range(len(edge) - 2, -1, -1):
            width = below[i + 1] - below[i]
            if width > 0:
                out = F.when(u < below[i + 1], F.lit(float(edge[i])) + (u - F.lit(below[i])) * F.lit((edge[i + 1] - edge[i]) / width)).otherwise(out)
        return out


class Seeded:
    """Distributions by name, or of one class, with a seed already given."""

    def __init__(self, seed=None, cls: type | None = None) -> None:
        self.seed, self.cls = seed, cls

    def __call__(self, *args, **kw) -> Distribution:
        return self.cls(*args, seed=self.seed, **kw)

    def __getattr__(self, name: str) -> Callable:
        return lambda *args, **kw: globals()[name](*args, seed=self.seed, **kw)
