"""deedlens.plans"""
