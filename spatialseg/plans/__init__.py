"""spatialseg.plans"""
