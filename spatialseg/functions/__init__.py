"""spatialseg.functions"""
