"""DataFrame operators that know nothing about laptops or movies."""
