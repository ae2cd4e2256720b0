"""Physical and business metrics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterflow.functions.scalars import col, safe_div

# water's heat per m3 and K in kWh, default efficiencies, gas energy and price, nominal heat output, default prices.
WATER_KWH = 1.163
DEFAULT_COP = 3.0
LEGACY_COP = 3.5
GAS_KWH_PER_M3 = 9.7
GAS_PRICE_PER_M3 = 2.8
BOILER_EFFICIENCY = 0.9
HEATING_NOMINAL_KW = 1000.0
CCHP_EFFICIENCY = 0.8
DEFAULT_PRICES = {"electricity": 0.8, "cooling": 0.3, "heating": 0.35, "gas": GAS_PRICE_PER_M3 / GAS_KWH_PER_M3}


def water_power(flow, supply_temp, return_temp) -> Column:
    """Cooling power in kW of a water flow, where the temperature difference is positive."""
    difference = col(return_temp) - col(supply_temp)
    return F.when(difference > 0, col(flow) * difference * WATER_KWH)


def power_or_estimate(power, run_flag, flow, supply_temp, return_temp, cop: float = DEFAULT_COP) -> Column:
    """The measured power; where it is missing, the unit runs and water flows, what its cooling takes at a fixed efficiency."""
    return F.coalesce(col(power), F.when((col(run_flag) > 0) & (col(flow) > 0), water_power(flow, supply_temp, return_temp) / cop))


def run_ratio(running, samples) -> Column:
    return safe_div(running, samples)


def energy(runtime_hours, power) -> Column:
    """0 for a stopped unit; NULL for one that runs without a known power."""
    return F.when(col(runtime_hours) <= 0, 0.0).otherwise(col(power) * col(runtime_hours))


def cooling_capacity(runtime_hours, flow, supply_temp, return_temp, power, cop: float = DEFAULT_COP) -> Column:
    """0 for a stopped unit, else from the water, else from the power."""
    return F.when(col(runtime_hours) <= 0, 0.0).otherwise(F.coalesce(water_power(flow, supply_temp, return_temp), col(power) * cop))


def cooling_supply(capacity, runtime_hours) -> Column:
    return col(capacity) * col(runtime_hours)


def gas_energy(gas_m3) -> Column:
    return col(gas_m3) * GAS_KWH_PER_M3


def gas_heat(gas_m3) -> Column:
    return gas_energy(gas_m3) * BOILER_EFFICIENCY


def burner_runtime(runtime, load_pct) -> Column:
    """The measured share of an hour, else the load's."""
    return F.coalesce(col(runtime), F.when(col(load_pct) > 0, F.least(col(load_pct) / 100.0, F.lit(1.0))), F.lit(0.0))


def allocation_weight(runtime, load_pct) -> Column:
    return F.when(col(runtime) > 0, F.when(col(load_pct) > 0, col(runtime) * col(load_pct)).otherwise(col(runtime))).otherwise(0.0)


def gas_group(number, first_group=("1", "4"), labels=("14", "23")) -> Column:
    return F.when(col(number).isin(*first_group), labels[0]).otherwise(labels[1])


def cchp_input(gas_kwh, supply) -> Column:
    """Energy from gas, else what the supply takes."""
    return F.coalesce(col(gas_kwh), F.when(col(supply) > 0, col(supply) / CCHP_EFFICIENCY), F.lit(0.0))


def heating_quality(measured, weight) -> Column:
    """Where a heating figure comes from."""
    return F.when(col(measured).isNull(), "load_estimated").when(col(weight) > 0, "gas_delta_allocated_by_load").otherwise("gas_delta_equal_allocated")


def row_cop(supply, energy, capacity=None, power=None) -> Column:
    """Supply by energy, else capacity by power, else 0."""
    other = [] if capacity is None else [safe_div(capacity, power)]
    return F.coalesce(safe_div(supply, energy), *other, F.lit(0.0))


def primary_supply(supply, *carriers) -> Column:
    """The total supply; where it is 0 or missing, the carriers' sum."""
    total = sum((F.coalesce(col(c), F.lit(0.0)) for c in carriers), F.lit(0.0))
    return F.when(F.coalesce(col(supply), F.lit(0.0)) != 0, col(supply)).otherwise(total)


def input_price(system, electricity, gas) -> Column:
    """Heating and CCHP burn gas, all others take electricity."""
    return F.when(col(system).isin("heating", "cchp"), col(gas)).otherwise(col(electricity))
