"""spatialith.functions"""
